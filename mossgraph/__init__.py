"""A Spark-native engine for longitudinal knowledge: an event log, derived views, and queries over them."""
