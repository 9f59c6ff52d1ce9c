"""tessera: panel analytics on Spark.

Operators for panels of daily series and dated text corpora, written as
DataFrame / SQL / Structured Streaming plans:

* ``tessera.operators.series``   positions, halo windows, two-level scans
* ``tessera.operators.*``        indicators, samples, news, embeddings, splits,
                                 scaling, metrics, stats, adf, models, search, guards
* ``tessera.sources``            fixture views, readers, sinks
* ``tessera.functions``          column functions and the UDF surface
* ``tessera.streaming``          streaming ingestion and daily windows
* ``tessera.plans.catalog``      the registered queries (see ``__spark_entry__``)
"""

__version__ = "0.1.0"
