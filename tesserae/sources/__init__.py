"""Readers of manifests and inventories, and a partitioned sink."""
