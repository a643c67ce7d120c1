"""Subpackage of docquarry."""
