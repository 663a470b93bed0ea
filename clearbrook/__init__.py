"""Spark-native data quality: load, profile, scan, plan, clean, validate, export."""
