"""Readers, small dimensions and writers."""
