"""Operators for preparing corpora to train language models on."""
