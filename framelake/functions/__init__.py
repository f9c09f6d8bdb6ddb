"""Column functions and vectorised kernels."""
