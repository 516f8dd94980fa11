"""Readers and writers of a vault's plain files."""
