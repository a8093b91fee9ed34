"""Relational, interval, sequence, ranking and statistical operators."""
