"""Readers. Every reader returns a DataFrame with an explicit schema (no inference)."""
