"""Training-data operators: fingerprints, filters, joins, tokenizers, mixing and sharding on Spark."""
