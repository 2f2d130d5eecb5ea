"""Column expressions. Nothing here starts a job and nothing runs in Python per row."""
