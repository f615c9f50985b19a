"""Where collections come from: rows, files, and functions of an index."""
