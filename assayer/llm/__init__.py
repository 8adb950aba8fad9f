"""Training-data operators: packing, filtering, deduplication and scanning of documents."""
