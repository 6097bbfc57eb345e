"""Stateful operators: freshness of pages and history of metrics, in batch and as streams."""
