"""Operators for building training corpora: scoring, filtering, de-duplication, mixing, sharding and chat formatting.

Nothing outside this subpackage imports it.  ``queries`` lists what it registers.
"""
