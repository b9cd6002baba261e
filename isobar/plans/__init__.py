"""Entry points that compose operators: bias correction, downscaling, cross-validation."""
