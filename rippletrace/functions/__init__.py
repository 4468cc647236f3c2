"""Scalar functions: canonical JSON and hashes, id predicates, rendering."""
