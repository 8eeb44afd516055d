"""Column expressions: hex grid, geometry and text. No Python UDFs."""
