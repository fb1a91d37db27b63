"""Column expressions and the numeric kernels that run inside Spark tasks."""
