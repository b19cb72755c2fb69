"""Complete jobs composed of operators."""
