"""Column expressions and kernels on planar geometry."""
