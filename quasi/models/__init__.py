"""Regression, weighting-model, tree and neighbour estimators."""
