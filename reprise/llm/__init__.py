"""Training-data operators: packing, sharding, language, mixing, joins, search, dedup, toxicity, secrets."""
