"""Contracts and flows compiled into DataFrame plans."""
