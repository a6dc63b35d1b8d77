"""Operators for preparing language-model training corpora.

Every module is self-contained: nothing outside this subpackage imports it.
"""
