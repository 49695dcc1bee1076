"""Operators for preparing training data: mixing, decontamination, near duplicates, licences, token files, quality, sharding."""
