"""Readers and writers of logs, manifests, run records and snapshots."""
