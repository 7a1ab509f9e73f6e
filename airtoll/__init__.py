"""Exposure, health-damage and disparity analytics as Spark DataFrame functions."""
