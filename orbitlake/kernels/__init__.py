"""Vectorised kernels in NumPy, free of Spark."""
