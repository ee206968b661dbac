"""Incremental variants of decomposable operators."""
