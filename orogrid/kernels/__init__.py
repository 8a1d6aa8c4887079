"""NumPy kernels of one cell's fit, run by Spark on grouped Arrow batches."""
