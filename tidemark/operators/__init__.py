"""Subpackage of tidemark."""
