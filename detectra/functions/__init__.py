"""Column and numeric functions: distributions, kernels, grids and keyed draws."""
