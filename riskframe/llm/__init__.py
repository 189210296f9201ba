"""Training-data operators (packing, dedup, joins, counts, filters, mixing).

Nothing outside this package and ``corpus_pipeline.py`` imports it.
"""
