"""Estimators, scorers, whole pipelines and the registry of queries."""
