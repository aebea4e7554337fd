"""Training-data operators: cleaning, dedup, decontamination, mixing, packing and web extraction.

Nothing else in the package imports this subpackage; ``llm.queries`` lists its queries.
"""
