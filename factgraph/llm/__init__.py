"""Operators of a training-data pipeline: packing, counting, formatting,
extraction, deduplication, sharding, scoring and decontamination."""
