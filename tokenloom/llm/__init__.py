"""Training-data operators: fingerprints, language, quality, dedup, mixing, tokens, packing, shards, chat."""
