"""Column expressions: comparison of cells and validation rules."""
