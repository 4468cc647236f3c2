"""Workloads projected from star-schema tables, and executable plan steps."""
