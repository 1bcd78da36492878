"""Set operations on messages, counters and runs: DataFrames in, DataFrames out."""
