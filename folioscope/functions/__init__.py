"""Column functions: paths, text, timestamps and fixed lookup values."""
