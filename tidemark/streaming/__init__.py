"""Snapshots as micro-batches."""
