"""Loomtrace: transcript analytics on Spark.

Plain DataFrame/SQL operators over append-only conversation transcripts and the
tables derived from them. Subpackages:

* ``functions`` - column expressions (text, JSON, scores)
* ``operators`` - relational building blocks (search, dedup, ranking, upserts)
* ``sources``   - JSONL line sources, batch and streaming
* ``streaming`` - incremental ingest, session state, service events
* ``plans``     - registered queries with their SQL twins
* ``llm``       - training-data operators; optional, nothing else imports it
"""

__version__ = "0.1.0"
