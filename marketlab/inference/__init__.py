"""Validation of backtests: overfitting, cross-validation, resampling."""
