"""Structured Streaming: live bars, duplicate-free trades, latest-wins merging."""
