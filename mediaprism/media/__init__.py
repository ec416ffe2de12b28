"""Parsing of media bytes: pure functions, and one Arrow stage that applies them."""
