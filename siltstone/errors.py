"""Errors with the codes and HTTP statuses of the service."""

from __future__ import annotations


class EngineError(Exception):
    """An error a caller can act on: ``code``, ``status`` and a message."""

    code, status, prefix = "INTERNAL_ERROR", 500, "Internal error: "

    def __init__(self, message: str = ""):
        super().__init__(f"{self.prefix}{message}")


def _kind(name: str, code: str, status: int, prefix: str) -> type[EngineError]:
    return type(name, (EngineError,), {"code": code, "status": status, "prefix": prefix, "__doc__": f"HTTP {status} {code}."})


# The service's codes, statuses and messages.
CollectionNotFound = _kind("CollectionNotFound", "COLLECTION_NOT_FOUND", 404, "Collection not found: ")
DocumentNotFound = _kind("DocumentNotFound", "DOCUMENT_NOT_FOUND", 404, "Document not found: ")
CollectionExists = _kind("CollectionExists", "COLLECTION_EXISTS", 409, "Collection already exists: ")
IndexExists = _kind("IndexExists", "INDEX_EXISTS", 409, "Index already exists: ")
IndexNotFound = _kind("IndexNotFound", "INDEX_NOT_FOUND", 404, "Index not found: ")
InvalidDocument = _kind("InvalidDocument", "INVALID_DOCUMENT", 400, "Invalid document: ")
InvalidQuery = _kind("InvalidQuery", "INVALID_QUERY", 400, "Invalid query: ")
InvalidIndex = _kind("InvalidIndex", "INVALID_INDEX", 400, "Invalid index: ")
InvalidPipeline = _kind("InvalidPipeline", "INVALID_PIPELINE", 400, "Invalid pipeline: ")
SchemaViolation = _kind("SchemaViolation", "SCHEMA_VIOLATION", 400, "Schema violation: ")
DocumentConflict = _kind("DocumentConflict", "DOCUMENT_CONFLICT", 409, "Document conflict: ")
DocumentTooLarge = _kind("DocumentTooLarge", "DOCUMENT_TOO_LARGE", 413, "Document too large")
QueryTimeout = _kind("QueryTimeout", "QUERY_TIMEOUT", 408, "Query exceeded timeout of ")
StoragePoisoned = _kind("StoragePoisoned", "STORAGE_POISONED", 503, "Storage engine poisoned: ")
Unauthorized = _kind("Unauthorized", "UNAUTHORIZED", 401, "")
NoSuchRoute = _kind("NoSuchRoute", "NOT_FOUND", 404, "No such resource: ")
WrongMethod = _kind("WrongMethod", "METHOD_NOT_ALLOWED", 405, "Method not allowed: ")
