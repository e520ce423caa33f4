"""Table operators: DataFrames in, lazy DataFrames out."""
