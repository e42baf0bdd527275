"""Training-data pipeline operators: quality, sharding, extraction, packing, scoring, licences, dedup, decontamination, PII."""
