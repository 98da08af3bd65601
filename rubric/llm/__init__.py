"""Training-data operators: filters, deduplication, tokenisation and packing of documents."""
