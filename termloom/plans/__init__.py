"""Workflows composed of the operators."""
