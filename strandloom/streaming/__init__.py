"""Incremental arrival of genomes."""
