"""Training-data operators: language, toxicity and quality models, exact and near
duplicates, decontamination, URL judgement, sharding, packing and WARC archives.

Nothing outside this subpackage imports it.
"""
