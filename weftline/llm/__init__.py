"""Operators of a training-data pipeline: filtering, near-duplicate joins, scoring, packing, token files and web archives."""
