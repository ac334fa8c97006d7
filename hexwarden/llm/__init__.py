"""Operators for preparing training data: documents, vectors and web pages in, decisions and files out.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it. Operators take and return DataFrames and
name the columns they need; further columns of the input are left alone.
"""
