"""A Spark-native engine for recorded exchanges with language-model services."""
