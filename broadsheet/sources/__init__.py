"""Landed files and snapshots in, unified items out."""
