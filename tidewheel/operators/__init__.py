"""Operators from bars to bars, labels, trades and reports."""
