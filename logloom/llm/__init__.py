"""Operators for preparing training text: extraction, filtering, near-duplicates, decontamination, sharding and scoring."""
