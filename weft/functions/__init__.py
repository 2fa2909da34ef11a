"""Scalar, array and object functions as Spark Column expressions, and the registry that programs name them by."""
