"""Operators for preparing training text: near-duplicates, tokens, filters, audits and scoring."""
