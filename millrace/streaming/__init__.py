"""Stateful streaming counterparts of the batch operators."""
