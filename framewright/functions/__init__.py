"""Column expressions and small in-task kernels."""
