"""Adapters, serving queries and the query registry."""
