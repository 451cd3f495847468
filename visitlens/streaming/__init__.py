"""Structured Streaming forms of the ad click jobs."""
