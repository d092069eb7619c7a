"""Spark jobs for order, inventory and delivery analytics."""
