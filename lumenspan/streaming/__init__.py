"""Profiles for documents as they arrive."""
