"""Readers of delivery files."""
