"""Preparation of language-model training data: one module for each operator."""
