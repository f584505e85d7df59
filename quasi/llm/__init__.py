"""Operators for preparing large text corpora and searching vectors."""
