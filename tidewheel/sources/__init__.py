"""Reading and writing bars, trades, funding and state."""
