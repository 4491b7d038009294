"""Forecasts over many series at once: baselines, regressions, trees, smoothing, backtests."""
