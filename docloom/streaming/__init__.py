"""Streaming versions of ingest, metrics and sessions. Extensions: the batch operators are the reference for their results."""
