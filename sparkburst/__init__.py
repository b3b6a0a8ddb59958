"""Burst search and catalogue analytics on Spark."""
