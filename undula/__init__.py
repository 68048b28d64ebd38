"""A PySpark-native analytics engine for multivariate time series and training-data corpora."""
