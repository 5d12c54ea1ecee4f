"""Versioned declaration catalogue on Spark."""
