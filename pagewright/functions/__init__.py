"""Subpackage; see its modules."""
