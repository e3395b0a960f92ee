"""The function library: scalar functions and aggregates, each as a Spark expression."""
