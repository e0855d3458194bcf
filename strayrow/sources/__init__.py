"""Scans: declared-schema files, landed trees, message streams, replayed tables."""
