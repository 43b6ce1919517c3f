"""Training-data operators: deduplication, audit, sharding, tokens, decontamination, toxicity."""
