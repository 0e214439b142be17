"""Reading and writing tables, and parsing saved pages."""
