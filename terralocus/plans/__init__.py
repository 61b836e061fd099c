"""Whole answers composed from the operators."""
