"""Operators: alignment, native and fitted bias correction, predictors, models."""
