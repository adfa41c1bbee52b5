"""Operator chains: scoring, training and evaluation jobs."""
