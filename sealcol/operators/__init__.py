"""Logical operators over sealed tables."""
