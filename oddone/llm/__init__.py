"""Operators for preparing training data at scale, one module per operator.

Nothing outside this package imports it; ``corpus_pipeline.py`` chains five of the operators.
"""
