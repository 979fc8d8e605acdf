"""Source text to a table of syntax nodes."""
