"""Tick-lake functions."""
