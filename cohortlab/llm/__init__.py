"""Operators of a training-data pipeline: mixing, WARC, decontamination,
toxicity, quality, personal data, near duplicates, secrets and licences.

Nothing else in the library imports this subpackage.
"""
