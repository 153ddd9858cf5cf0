"""labtables: Spark-native cleaning, exploration, linkage, scoring and corpus work on tables."""
