"""Scalar functions: column expressions and small numeric kernels."""
