"""Marketplace analytics as composable Spark DataFrame operators."""
