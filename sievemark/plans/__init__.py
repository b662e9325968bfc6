"""Registered queries and end-to-end flows."""
