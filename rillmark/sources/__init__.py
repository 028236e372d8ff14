"""Readers and writers of corpora, runs and judgments."""
