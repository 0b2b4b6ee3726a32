"""Readers and writers of fact tables, diffs and source text."""
