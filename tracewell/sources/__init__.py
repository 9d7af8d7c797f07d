"""Readers: documents, JDBC, static tables, snapshots, API payloads."""
