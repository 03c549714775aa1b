"""Batch jobs on Spark for seasonal surveillance data and probabilistic forecasts."""
