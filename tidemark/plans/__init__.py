"""Whole jobs: tiered search, batched searches, migration."""
