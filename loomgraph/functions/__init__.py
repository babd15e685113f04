"""Subpackage functions of the code-graph engine."""
