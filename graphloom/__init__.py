"""graphloom: build, check and score sentence-to-meaning-graph corpora with Spark.

Every operator is a function from DataFrame to DataFrame.  Bracketed graph text is
decoded once into a nested ``triples`` column by native Spark expressions, so the
graph operators are projections, filters, joins and aggregations.
"""

__version__ = "0.1.0"
