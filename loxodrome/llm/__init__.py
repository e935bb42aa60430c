"""Operators for preparing language-model training text at corpus scale.

Nothing outside this subpackage imports it; see ``queries.py`` for the entry
points and ``corpus_pipeline.py`` at the repository top for their chain.
"""
