"""Covariance kernels, likelihood families and numerical routines."""
