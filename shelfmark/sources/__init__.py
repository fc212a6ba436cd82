"""Readers and writers around the operators."""
