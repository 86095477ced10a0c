"""oddone: triplet-similarity analytics as ordinary Spark DataFrame jobs.

Sub-packages
------------
functions  column expressions (prompt rendering, answer cleaning, vectors, metadata, run log)
sources    readers for concept tables, vector matrices, answer CSVs, configs, manifests, logs
sinks      writers for stimuli, answers, embeddings and the run log
operators  relational building blocks (dense ids, sampling, distances, scoring, fitting)
plans      end-to-end experiment plans (triplet run, embedding run, metadata, manifests)
streaming  the stateless scoring/answer plan on a streaming DataFrame
catalog    the registered queries with their SQL oracles
"""

__version__ = "0.1.0"
