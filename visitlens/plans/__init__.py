"""Whole jobs, each a composition of operators from DataFrame to DataFrame."""
