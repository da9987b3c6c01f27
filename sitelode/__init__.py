"""Sitelode: a Spark-native engine that turns web pages into a searchable corpus.

Subpackages: ``functions`` (Column -> Column), ``operators`` (DataFrame ->
DataFrame), ``sources`` (readers, writers, stores), ``plans`` (whole pipelines
and the query catalogue) and ``streaming`` (incremental ingest).  The optional
subpackage ``llm`` holds training-data operators; nothing else imports it.
"""

__version__ = "0.1.0"
