"""Operators for text that models are trained on. Nothing outside this package imports it."""
