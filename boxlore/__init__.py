"""A Spark-native engine for box annotations: geometry, fusion, evaluation, splits, journals and their contracts."""
