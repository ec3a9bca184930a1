"""Operators for building training corpora; nothing else in this library imports this subpackage."""
