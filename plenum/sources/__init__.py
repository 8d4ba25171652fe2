"""Readers and writers: tables, JSON documents, paged results, key-value snapshots."""
