"""Gaussian-process inference on spatial and space-time points with ordered conditional approximations, on Spark."""
