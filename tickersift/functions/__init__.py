"""Column-level helpers: numbers, dates, text patterns and charsets."""
