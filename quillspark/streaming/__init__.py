"""Stateful forms of the operators for event streams."""
