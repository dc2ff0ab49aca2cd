"""Column expressions. Nothing here reads or writes data."""
