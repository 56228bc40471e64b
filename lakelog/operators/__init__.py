"""Table operators: DataFrames in, lazy DataFrames out, unless a docstring says that a job runs."""
