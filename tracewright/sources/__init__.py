"""Readers and writers: traces as text, CSV or JSON, sample files, snapshots."""
