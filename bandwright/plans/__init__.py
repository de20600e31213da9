"""Fixture views, the registered queries and the experiment registry."""
