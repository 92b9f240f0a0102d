"""Relational operators over long tables of a model."""
