"""A PySpark-native engine for document extraction: DataFrame in, DataFrame out."""
