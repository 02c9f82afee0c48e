"""Synchronised sensor-frame datasets and their evaluation, as lazy Spark DataFrame functions."""
