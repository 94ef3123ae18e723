"""Functions of columns, and parsers of lines."""
