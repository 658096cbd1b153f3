"""Training-data operators: extraction, deduplication, filtering, tokenising and packing of documents."""
