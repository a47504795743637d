"""Training-data operators: language ID, media, WARC, quality, sharding, licences, dedup, decontamination, packing.

Nothing outside this subpackage (and corpus_pipeline.py) imports it.
"""
