"""Training-data operators: language ID, packing, deduplication, PII, sketches and the like.

Nothing outside this subpackage imports it; `registry` lists the queries it offers.
"""
