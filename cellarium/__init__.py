"""Spatial key analytics and data preparation on Spark."""
