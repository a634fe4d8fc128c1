"""Batch operators on bars, archives' manifests and messages."""
