"""Readers, writers and corpus generators."""
