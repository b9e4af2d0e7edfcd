"""Quillon: sparse-fingerprint and corpus analytics expressed as Spark plans."""
