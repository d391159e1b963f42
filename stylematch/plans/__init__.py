"""Compositions: catalogue and outfit cleaning, scoring, evaluation, cards, features, clustering."""
