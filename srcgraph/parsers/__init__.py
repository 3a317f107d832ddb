"""Parsers that turn source bytes into syntax trees."""
