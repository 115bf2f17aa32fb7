"""weftlog: a Spark-native event log, CQRS and training-data analytics engine.

Sub-packages
------------
functions   column expressions, codecs and validation rules
sources     log schema, fixtures, generators, the commit log
operators   reads, paging, folds, snapshots, upcasting, outbox, crypto, metrics
streaming   projections and subscriptions
plans       the registered queries and their SQL twins
llm         operators for training-data pipelines (nothing else imports it)
"""

__version__ = "0.1.0"
