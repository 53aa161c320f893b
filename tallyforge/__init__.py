"""Reasoning-data analytics on Spark."""
