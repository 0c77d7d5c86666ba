"""Training-data operators: licence scan, language id, exact search, toxicity, decontamination, mixing,
URL filter, personal data, repeated passages, near-duplicate joins, byte-pair encoding, centroid clustering and
conversation repair.

Nothing outside this subpackage (and the pipeline module at the repository top) imports it.
"""
