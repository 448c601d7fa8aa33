"""Operators for building large text corpora; nothing outside this folder imports it."""
