"""Time-series preparation, alignment, features, backtests and scores on Spark DataFrames."""
