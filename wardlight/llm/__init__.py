"""Operators that prepare text corpora for training, each written for skewed data at cluster scale."""
