"""Operators for preparing language-model training data.

Nothing outside this folder, ``corpus_pipeline.py`` and the guarded import in
``__spark_entry__.py`` refers to this subpackage.
"""
