"""Operators on large text corpora; nothing outside this subpackage imports it."""
