"""Training-data operators: deduplication, scoring, decontamination, tokens, packing, chat text and shards."""
