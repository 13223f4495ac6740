"""DataFrame operators: each takes and returns DataFrames and leaves the work to Spark."""
