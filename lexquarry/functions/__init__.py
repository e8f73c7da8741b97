"""Column functions: every one takes and returns Columns."""
