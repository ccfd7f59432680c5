"""Readers and writers of mail."""
