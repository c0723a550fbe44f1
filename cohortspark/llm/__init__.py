"""Training-data operators: scoring, tokens, near-duplicates, decontamination, archives, packing, chat.

Nothing else in the library imports this package.
"""
