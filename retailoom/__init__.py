"""Retail and wholesale sales analytics as plain PySpark DataFrame operators."""
