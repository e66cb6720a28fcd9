"""Joins, ordered folds, aggregates and reports over the tables the sources produce."""
