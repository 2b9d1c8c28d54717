"""What is computed over the rows."""
