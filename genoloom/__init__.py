"""Variant annotation on Spark."""
