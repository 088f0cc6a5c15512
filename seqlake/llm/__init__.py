"""Training-data pipeline operators: archives, decontamination, packing, secrets, sharding,
language ID, near-duplicates, quality rules, language-model scoring and token files.

Nothing else in the package imports this subpackage.
"""
