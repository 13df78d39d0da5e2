"""Operators of a training-data pipeline on Spark.

Each module holds one operator with its own general interface; ``queries``
derives the registered ``opN_*`` results from them.  Nothing outside this
subpackage (and ``corpus_pipeline.py``) imports it.
"""
