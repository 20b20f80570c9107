"""Readers and writers: file corpora, CSV tables, JSON caches, notebooks, listings."""
