"""Training-data operators: deduplication, decontamination, packing, scoring, archives and sharding.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is present.
"""
