"""A PySpark-native analytics engine for small-cohort, many-feature studies."""
