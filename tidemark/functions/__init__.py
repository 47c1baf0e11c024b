"""Column functions: byte codecs and statistics."""
