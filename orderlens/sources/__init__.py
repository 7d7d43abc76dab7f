"""Readers, writers and the labelled order table."""
