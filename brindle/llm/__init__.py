"""Training-data operators: tokenising, deduplication, filtering, scoring, mixing."""
