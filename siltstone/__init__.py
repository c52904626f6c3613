"""siltstone: document analytics on Spark.

A JSON filter language, aggregation pipelines, distinct queries, document collections with revisions, layouts and
value-count rollups, all compiled to DataFrame plans, together with data-preparation operators built for large, skewed
inputs.
"""

__version__ = "0.1.0"
