"""lodestone: a PySpark-native engine for content-addressed knowledge."""
