"""The delta ledger's columns. Every row family is a projection of it."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, LongType, MapType, StringType, StructField, StructType

DELTA_COLUMNS = {
    "seq": "bigint",
    "op_index": "bigint",
    "delta_index": "bigint",
    "kind": "string",
    "inode_id": "bigint",
    "inode_kind": "string",
    "parent_id": "bigint",
    "name_key": "string",
    "display_name": "string",
    "revision_no": "bigint",
    "content_id": "bigint",
    "size_bytes": "bigint",
    "checksum": "string",
    "attributes_revision_no": "bigint",
    "attributes": "map<string,string>",
    "access_revision_no": "bigint",
    "boundary": "boolean",
    "grants": "map<string,bigint>",
    "target_seq": "bigint",
    "committed_by": "string",
    "committed_at_ms": "bigint",
}
_TYPES = {"bigint": LongType(), "string": StringType(), "boolean": BooleanType(), "map<string,string>": MapType(StringType(), StringType()), "map<string,bigint>": MapType(StringType(), LongType())}
DELTAS = StructType([StructField(c, _TYPES[t]) for c, t in DELTA_COLUMNS.items()])
#: Grants of one access revision (fixed value).
MAX_GRANTS = 1_000

#: Delta kinds.
CREATE, BIND, UNBIND, REVISE = "create_inode", "bind_direntry", "unbind_direntry", "append_file_revision"
DELETE, REVOKE, ATTRIBUTES, ACCESS = "tombstone_subtree", "revoke_subtree_tombstone", "append_attributes_revision", "append_access_revision"

#: Access rights as bits, in order; admin is the last.
RIGHTS = ["read", "list", "create", "write", "delete", "move", "share", "admin"]
ADMIN = 128
ROOT = 0
"""The root directory's inode."""
MAX_DEPTH = 128
