"""Column functions: bits, text by code point, arrays and map columns."""
