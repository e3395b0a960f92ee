"""Column-store style analytics over nested data, on Spark."""
