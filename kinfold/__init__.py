"""Grouped splitting, weighting and evaluation of labelled items on Spark."""
