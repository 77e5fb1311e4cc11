"""Table and model readers and writers."""
