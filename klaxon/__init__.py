"""klaxon: alert-stream analytics as Spark DataFrame operators.

Every operator is a function from DataFrames to DataFrames.  They compose with
``df.transform``, run on batch tables and, where they keep no cross-row state of their
own, unchanged on streaming DataFrames.  Stateful streaming forms live in
``klaxon.streaming``.
"""
