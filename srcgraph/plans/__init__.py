"""From files to nodes and facts; tree patterns."""
