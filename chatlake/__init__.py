"""Spark-native analytics over chat data: tables in, tables out."""
