"""Composite steps and registered queries."""
