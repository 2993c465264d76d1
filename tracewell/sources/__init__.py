"""Readers and writers: source trees, corpora, reports, and feature extractors of source files."""
