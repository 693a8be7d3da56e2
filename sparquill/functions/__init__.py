"""Sparquill functions."""
