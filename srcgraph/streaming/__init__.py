"""The same plans over files that keep arriving."""
