"""Readers, writers and the dataset catalogue."""
