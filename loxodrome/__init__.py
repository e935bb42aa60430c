"""A Spark-native engine for place registers, regions and street networks."""
