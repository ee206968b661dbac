"""Relational operators over object-centric logs."""
