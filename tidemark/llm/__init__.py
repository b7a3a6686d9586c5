"""Training-data operators: sharding, cleaning, similarity joins, media, privacy,
toxicity, substring removal, mixing, tokenisation and URL filtering.

Nothing outside this package imports it.
"""
