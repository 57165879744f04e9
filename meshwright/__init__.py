"""Spark-native field analytics: every operator is a DataFrame-to-DataFrame function."""
