"""Raw files and tables."""
