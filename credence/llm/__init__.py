"""Training-data operators: dedup, decontamination, packing, token files, language and licence models.

Each module holds one operator with its own general interface; ``catalog`` holds the thin
queries over the driver's tables.  Nothing outside this package imports it, except the guarded
registration in ``__spark_entry__.py``.
"""
