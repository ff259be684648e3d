"""Tick and trade analytics as Spark DataFrame operators."""
