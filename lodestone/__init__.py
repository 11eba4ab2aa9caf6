"""Spark-native uplift measurement, targeting-policy analytics and corpus preparation."""
