"""What the service says of requests that it refuses."""

# The sentences that callers of the service know.
FILTER_DEPTH = "Filter nesting depth exceeds maximum of {}"
FILTER_FORM = "Filter must be a JSON object"
MUST_BE_ARRAY = "{} must be an array"
FILTER_BRANCHES = "Filter branch count exceeds maximum of {}"
UNKNOWN_OPERATOR = "Unknown operator: {}"
PATH_DEPTH = "Field path depth exceeds maximum of {}"
REGEX_LENGTH = "Regex pattern exceeds maximum length of {}"
REGEX = "Invalid regex pattern: {}"
NO_STAGES = "Pipeline cannot be empty"
STAGES = "Pipeline limited to {} stages"
STAGE_FORM = "Stage {} must be an object"
STAGE_KEYS = "Stage {} must have exactly one key"
STAGE_NUMBER = "Stage {}: {} must be a positive integer"
STAGE_NAME = "Stage {}: unknown stage '{}'"
GROUP_FORM = "Stage {}: $group must be an object"
GROUP_KEY = "Stage {}: $group requires '_id' field"
ACCUMULATOR_FORM = "Stage {}: accumulator '{}' must be an object"
ACCUMULATOR_KEYS = "Stage {}: accumulator '{}' must have exactly one operator"
ACCUMULATOR_NAME = "Stage {}: unknown accumulator '{}'"
ACCUMULATOR_PATH = "Stage {}: {} requires a field path string"
SORT_FORM = "Stage {}: $sort must be an object"
UPDATE_FORM = "Update must contain a $set object"
NAME_EMPTY = "Collection name cannot be empty"
NAME_UNDERSCORE = "Collection name cannot start with underscore"
NAME_CHARACTERS = "Collection name can only contain alphanumerics, underscore, dash, dot, hash, or dollar"
DOCUMENT_FORM = "Document must be a JSON object"
BULK = "Bulk insert limited to {} documents per request"
BULK_FORM = "Document {}: must be a JSON object"
BULK_SIZE = "Document {}: exceeds 16 MB size limit"
REVISION = "Expected rev {}, current is {}"
INDEX_EMPTY = "Index name cannot be empty"
INDEX_CHARACTERS = "Index name may only contain alphanumeric characters, underscores, and hyphens"
INDEX_NO_PATH = "At least one field path is required"
INDEX_PATH = "Field path cannot be empty"
INDEX_FIELDS = "Either 'field' or 'fields' must be provided"
RETENTION = "retention_days must be greater than 0"
