"""Limits of requests."""

# What the service accepts.
MAX_QUERY_LIMIT = 10_000
DEFAULT_QUERY_LIMIT = 100
MAX_FILTER_DEPTH = 20
MAX_FILTER_BRANCHES = 1_000
MAX_REGEX_BYTES = 1_024
MAX_PATH_SEGMENTS = 20
MAX_PIPELINE_STAGES = 100
COLLECT_CAP = 1_000
DISTINCT_LIMIT = 1_000
MAX_BULK_DOCUMENTS = 10_000
MAX_DOCUMENT_BYTES = 16 << 20
QUERY_TIMEOUT_S = 30
ROLLUP_CARDINALITY = 1_000
PROFILE_ROWS = 10_000

#: Rows that an answer of the service may have where the request sets no bound: more is an error, and DataFrames have none.
MAX_ANSWER_ROWS = 100_000
