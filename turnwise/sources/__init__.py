"""Readers for corpora, evaluation results and file inventories."""
