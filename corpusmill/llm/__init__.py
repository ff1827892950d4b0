"""Training-data operators (substring and near dedup, decontamination, token
counts, packing, toxicity, n-gram joins, WARC conversion, URL filters).

Nothing outside this subpackage and ``corpus_pipeline.py`` imports it.
"""
