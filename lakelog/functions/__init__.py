"""Column expressions: every function here returns a Column (or None) and runs no job."""
