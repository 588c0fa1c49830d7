"""Operators of a training-data pipeline: scoring, archives, sharding, cleaning, mixing, decontamination, languages, personal data, joins, filters."""
