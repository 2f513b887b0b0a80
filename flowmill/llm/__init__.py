"""Training-data operators: language ID, near-dedup, decontamination, mixing, token files and friends.

Each module holds one operator with a general interface; ``queries`` derives the registered
``opN_*`` digests from them. Nothing outside this subpackage imports it.
"""
