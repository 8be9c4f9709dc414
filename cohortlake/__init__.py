"""Spark operators for product-usage and conversion analytics."""
