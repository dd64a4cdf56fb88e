"""Training-data operators: deduplication, decontamination, packing, scoring, sharding."""
