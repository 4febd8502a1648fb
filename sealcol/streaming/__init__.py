"""Sealing and opening streams."""
