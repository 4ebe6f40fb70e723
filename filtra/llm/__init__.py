"""Training-data operators (PII, mixing, packing, ANN, dedup, LM, quality, sharding).

Nothing else in the library imports this subpackage.
"""
