"""quire: a Spark-native scoring engine for recognised text."""
