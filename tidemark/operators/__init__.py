"""Indicators, signals, targets, datasets, folds, models and metrics over panels."""
