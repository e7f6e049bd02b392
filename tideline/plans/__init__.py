"""Analyses composed from operators and functions."""
