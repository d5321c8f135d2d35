"""Readers and writers of relations."""
