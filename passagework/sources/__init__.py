"""Readers, writers and remote clients."""
