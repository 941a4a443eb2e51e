"""Corpus-preparation operators: one module per operator, plus ``queries`` that registers them."""
