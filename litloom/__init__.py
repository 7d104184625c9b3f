"""A PySpark-native engine for bibliographic corpora and training-data pipelines."""
