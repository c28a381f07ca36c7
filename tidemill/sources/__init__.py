"""Tick-lake sources."""
