"""Batch and streaming network-traffic risk analysis on Spark."""
