"""Explicit schemas of the index relations and the registry; nothing is inferred."""

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _I, _L, _B, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampType()

FILES = _schema(
    ("root_path", _S), ("file_path", _S), ("language", _S), ("mtime_ns", _L),
    ("size_bytes", _L), ("content_hash", _S), ("package_id", _S), ("indexed_at", _TS),
)
SYMBOLS = _schema(
    ("root_path", _S), ("file_path", _S), ("name", _S), ("kind", _S), ("line", _I),
    ("end_line", _I), ("parent", _S), ("visibility", _S), ("signature", _S),
)
IMPORTS = _schema(("root_path", _S), ("file_path", _S), ("target", _S), ("line", _I))
IDENTIFIERS = _schema(("root_path", _S), ("file_path", _S), ("token", _S), ("line", _I))
DEPS = _schema(
    ("root_path", _S), ("importer_file", _S), ("importee_file", _S), ("raw_target", _S), ("line", _I),
)
CALLSITES = _schema(
    ("root_path", _S), ("caller_file", _S), ("caller_line", _I), ("caller_symbol", _S),
    ("callee_name", _S), ("callee_kind", _S),
)
PACKAGES = _schema(
    ("id", _S), ("identifier", _S), ("display_name", _S), ("source_type", _S), ("source_url", _S),
    ("source_branch", _S), ("path", _S), ("auto_pull", _B), ("harness", _S), ("shallow", _B),
    ("prepare_scope", _S), ("created_at", _TS), ("updated_at", _TS),
)
CONVERSATIONS = _schema(
    ("id", _S), ("package_id", _S), ("question", _S), ("harness", _S), ("exit_code", _I),
    ("log_path", _S), ("git_commit_sha", _S), ("git_branch", _S), ("created_at", _TS),
)
PREPARED = _schema(
    ("id", _S), ("package_id", _S), ("content", _S), ("created_at", _TS), ("harness", _S),
    ("model", _S), ("git_commit_sha", _S), ("git_branch", _S), ("prepare_scope_at_time", _S),
)
LOG = _schema(
    ("id", _S), ("package_id", _S), ("package_identifier", _S), ("question", _S), ("harness", _S),
    ("model", _S), ("started_at", _S), ("finished_at", _S), ("exit_code", _I), ("response", _S),
    ("pull_error", _S), ("git_commit_sha", _S), ("git_branch", _S), ("prepare_scope", _S),
)
MANIFEST_ENTRY = _schema(
    ("identifier", _S), ("git", _S), ("branch", _S), ("harness", _S), ("auto_pull", _B),
    ("shallow", _B), ("prepare_scope", _S),
)
