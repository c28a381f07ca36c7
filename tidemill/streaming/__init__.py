"""Tick-lake streaming."""
