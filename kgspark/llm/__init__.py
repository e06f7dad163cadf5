"""Training-data operators: deduplication, packing, scoring and scanning of document tables."""
