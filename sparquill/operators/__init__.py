"""Sparquill operators."""
