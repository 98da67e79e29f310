"""Training-data operators: tokenising, packing, near-duplicate and quality stages.

Nothing outside this subpackage imports it.
"""
