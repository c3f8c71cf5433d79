"""Operators for preparing text corpora; see the README of the repository."""
