"""Operators for training-data pipelines: licences, sharding, language model
scoring, language identification, benchmark decontamination, toxicity, secrets,
exact and near duplicates, byte-level BPE.  Nothing else in the library imports
this subpackage."""
