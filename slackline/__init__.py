"""Reliability analytics for scheduled services, on Spark."""
