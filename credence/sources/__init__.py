"""Readers and writers of corpora, stores, extraction records and caches."""
