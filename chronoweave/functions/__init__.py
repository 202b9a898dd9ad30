"""Column functions: clocks, fields, time."""
