"""Training-data operators: packing, search, scoring, dedup, scans, decontamination, fixity, sharding.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
