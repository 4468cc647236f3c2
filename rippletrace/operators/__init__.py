"""Operators over batches of artifacts, keyed by pair_id."""
