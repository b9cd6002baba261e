"""Reading and writing long-format grids."""
