"""Spark-native analytics over network flows, web pages and their alerts."""
