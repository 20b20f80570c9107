"""Operators of a training-data pipeline: archives, mixing, dedup, decontamination, scoring, search, extraction, language."""
