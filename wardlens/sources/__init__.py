"""Readers. Every reader takes a declared schema where the format allows one; nothing infers."""
