"""Composed jobs: test inputs, refresh chain and the query registry."""
