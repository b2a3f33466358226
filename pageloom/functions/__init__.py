"""Column builders: page ranges, text, geometry, labels and dates as built-in expressions."""
