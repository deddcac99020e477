"""Training-data operators: dedup, sharding, media, language id, BPE, mixing, URL filters.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it
can be imported.  Each module documents one operator; :mod:`veilspark.llm.queries` holds the
thin ``opN_*`` queries and :mod:`veilspark.llm.oracles` their SQL.
"""
