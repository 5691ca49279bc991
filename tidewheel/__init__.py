"""tidewheel: time-series features, labels and backtests as Spark jobs."""

__version__ = "0.1.0"
