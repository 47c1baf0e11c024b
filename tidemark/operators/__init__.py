"""Relational operators: snapshots, multi-version reads, compaction, log checks, routing, pages."""
