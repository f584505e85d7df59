"""Readers, writers and wave handling."""
