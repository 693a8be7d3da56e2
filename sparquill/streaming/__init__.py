"""Sparquill streaming."""
