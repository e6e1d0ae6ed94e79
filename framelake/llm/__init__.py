"""Operators for training-data pipelines: filtering, deduplication, mixing, tokenization.

Nothing else in the package imports this subpackage; it only uses the general
helpers of ``framelake.session``.
"""
