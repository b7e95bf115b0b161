"""Operators over node, load, slot and geometry tables."""
