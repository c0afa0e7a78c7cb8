"""slatekit: a Spark-native engine for recommendation re-ranking data.

Impression logs become filtered, vocabulary-encoded candidate lists (slates)
with sampled negatives and bounded histories; slates are reshaped per item
category, scored in batch or on a stream, and evaluated with NDCG, MAP,
utility, AUC, log loss and category-exposure divergence.

Every operator takes and returns DataFrames and is built from Spark SQL
expressions, joins, aggregations and windows.  No operator creates a session.
"""

__version__ = "0.1.0"
