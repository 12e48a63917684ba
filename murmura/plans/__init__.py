"""Composed plans: the registered queries over the driver tables, the ingest
flow, retrieval and report plans."""
