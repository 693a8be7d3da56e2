"""Sparquill sources."""
