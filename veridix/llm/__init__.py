"""Training-data operators: packing, counting, deduplication, scoring, extraction."""
