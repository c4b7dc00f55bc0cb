"""Scoring of point streams against a fixed plan."""
