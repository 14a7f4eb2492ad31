"""A PySpark-native engine for snapshot convergence, faceted retrieval and training data."""
