"""Trajectory landscape analytics on Spark."""
