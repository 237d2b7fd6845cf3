"""A Spark-native engine for uncertain, changing knowledge kept in plain tables."""
