"""Table operators: each takes and returns DataFrames keyed by series and time."""
