"""Whole plans: bundle assembly, rendering, and the query catalogue."""
