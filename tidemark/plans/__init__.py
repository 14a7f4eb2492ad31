"""Profiles, queries, building and publishing."""
