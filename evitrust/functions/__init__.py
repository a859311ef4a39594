"""Column-level building blocks: every function takes Columns and returns Columns."""
