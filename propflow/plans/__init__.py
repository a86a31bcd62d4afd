"""Whole flows: property table, estimates with evaluation, training sequences."""
