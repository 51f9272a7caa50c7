"""Column builders and array kernels."""
