"""A PySpark engine for uniformly sampled multi-track time series."""
