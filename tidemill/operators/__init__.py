"""Tick-lake operators."""
