"""Spark jobs for daily market panels: features, labels, walk-forward evaluation, backtests."""
