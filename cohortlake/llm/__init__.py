"""Training-data operators: tokenising, filtering, deduplication, search and mixing."""
