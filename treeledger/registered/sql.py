"""The same ledger in the oracle's SQL, built another way: a UNION ALL of plain selects with numbered rows."""

from __future__ import annotations

from ..schema import DELTA_COLUMNS
from ..sources.fixture import FILE, FOLDER, NATION, OTHER, USER

_KEEP = {"all": "true", "main": "(seq <= n // 2 or user_id % 3 in (1, 2))", "fork": "(seq <= n // 2 or user_id % 3 in (0, 2))"}
_TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "map<string,string>": "VARCHAR", "map<string,bigint>": "VARCHAR"}
#: Maps as text: entries k=v in order of key, with semicolons between.
ATTRIBUTES = "CASE WHEN k % 2 = 0 THEN 'even=yes;k=' || k ELSE 'k=' || k END"
_GRANT = "'p' || (({n}) % 4) || '=' || (1 + {r} % 127)"
GRANTS = f"CASE WHEN k % 3 = 0 THEN CASE WHEN k % 4 < (k + 1) % 4 THEN {_GRANT.format(n='k', r='k')} || ';' || {_GRANT.format(n='k + 1', r='7 * k')} ELSE {_GRANT.format(n='k + 1', r='7 * k')} || ';' || {_GRANT.format(n='k', r='k')} END ELSE {_GRANT.format(n='k', r='k')} END"


def _row(source: str, **given: str) -> str:
    return "SELECT " + ", ".join(f"CAST({given.get(c, 'NULL')} AS {_TYPES[t]}) AS {c}" for c, t in DELTA_COLUMNS.items()) + f" FROM {source}"


def ledger(namespace: str = "all", tag: str = "", with_marks: bool = True) -> str:
    """CTEs marks, ops, deltas and the families (names end in tag); no leading WITH, no trailing comma."""
    name = lambda m: f"('F' || (k % 10) || CASE WHEN {m} > 0 THEN '-M' || ({m}) ELSE '' END || '.txt')"
    edge = lambda m: {"parent_id": f"{FOLDER} + 2 * user_id + ({m}) % 2", "name_key": f"lower({name(m)})", "display_name": name(m)}
    ops = f"ops{tag}"
    common = {"seq": "seq", "op_index": "0", "committed_by": "'usr_' || user_id", "committed_at_ms": "ms", "inode_id": "file_id", "inode_kind": "'file'"}
    on = lambda op: f"{ops} WHERE op = '{op}'"
    rows = [
        _row(on("create"), delta_index="0", kind="'create_inode'", **common),
        _row(on("create"), delta_index="1", kind="'bind_direntry'", **common, **edge("0")),
        _row(on("create"), delta_index="2", kind="'append_file_revision'", revision_no="1", content_id="content_id", size_bytes="size_bytes", checksum="checksum", **common),
        _row(on("revise"), delta_index="0", kind="'append_file_revision'", revision_no="1 + revs", content_id="content_id", size_bytes="size_bytes", checksum="checksum", **common),
        _row(on("move"), delta_index="0", kind="'unbind_direntry'", **common, **edge("moves - 1")),
        _row(on("move"), delta_index="1", kind="'bind_direntry'", **common, **edge("moves")),
        _row(on("describe"), delta_index="0", kind="'append_attributes_revision'", attributes_revision_no="descriptions", attributes=ATTRIBUTES, **common),
        _row(on("share"), delta_index="0", kind="'append_access_revision'", access_revision_no="shares", boundary="k % 5 = 0", grants=GRANTS, **common),
        _row(on("delete"), delta_index="0", kind="'unbind_direntry'", **common, **edge("moves")),
        _row(on("delete"), delta_index="1", kind="'tombstone_subtree'", **common),
        _row(on("restore"), delta_index="0", kind="'revoke_subtree_tombstone'", target_seq="deleted_seq", **common),
        _row(on("restore"), delta_index="1", kind="'bind_direntry'", **common, **edge("moves")),
    ]
    user = {"inode_id": f"{USER} + c_custkey", "inode_kind": "'directory'"}
    uedge = {"parent_id": f"{NATION} + c_nationkey", "name_key": "'user_' || c_custkey", "display_name": "'User_' || c_custkey"}
    for mark, condition, kinds, target in (("s1", "c_custkey % 7 = 3", ("unbind_direntry", "tombstone_subtree"), None), ("s2", "c_custkey % 14 = 3", ("revoke_subtree_tombstone", "bind_direntry"), "s1")):
        source = f"customer, marks, events WHERE {condition} AND event_id + 1 = {mark}"
        for i, kind in enumerate(kinds):
            more = uedge if "direntry" in kind else {"target_seq": target} if target else {}
            rows.append(_row(source, seq=mark, op_index="1 + c_custkey", delta_index=f"{1000 + i} + 2 * c_custkey", kind=f"'{kind}'", committed_by="'usr_' || user_id", committed_at_ms="epoch_us(ts) // 1000", **user, **more))
    move = f"customer, marks, events WHERE {{}} AND event_id + 1 = late"
    at_late = {"seq": "late", "op_index": "1 + c_custkey", "committed_by": "'usr_' || user_id", "committed_at_ms": "epoch_us(ts) // 1000", "inode_kind": "'directory'", "name_key": "'user_' || c_custkey", "display_name": "'User_' || c_custkey"}
    away = f"{NATION} + (c_nationkey + 1) % 25"
    if namespace == "fork":
        source = move.format("c_custkey % 11 = 5 AND c_custkey % 7 <> 3")
        rows.append(_row(source, **at_late | user, delta_index="1000 + 2 * c_custkey", kind="'unbind_direntry'", parent_id=f"{NATION} + c_nationkey"))
        rows.append(_row(source, **at_late | user, delta_index="1001 + 2 * c_custkey", kind="'bind_direntry'", parent_id=away))
    if namespace == "main":
        source, new = move.format("c_custkey % 33 = 27"), {"inode_id": f"{OTHER} + c_custkey"}
        rows.append(_row(source, **{k: v for k, v in at_late.items() if "name" not in k} | new, delta_index="1000 + 2 * c_custkey", kind="'create_inode'"))
        rows.append(_row(source, **at_late | new, delta_index="1001 + 2 * c_custkey", kind="'bind_direntry'", parent_id=away))
    rows.append(_row("(SELECT 1 AS one)", seq="0", op_index="1", delta_index="1", kind="'append_access_revision'", inode_id="0", inode_kind="'directory'", access_revision_no="1", boundary="false", grants="'p0=255;p9=1;root=128'", committed_by="'system'", committed_at_ms="0"))
    for source, inode, parent, display in (
        ("(SELECT 1 AS one)", "0", None, ""),
        ("region", "1 + r_regionkey", "0", "r_name"),
        ("nation", f"{NATION} + n_nationkey", "1 + n_regionkey", "n_name"),
        ("customer", f"{USER} + c_custkey", f"{NATION} + c_nationkey", "'User_' || c_custkey"),
        ("customer", f"{FOLDER} + 2 * c_custkey", f"{USER} + c_custkey", "'Inbox'"),
        ("customer", f"{FOLDER} + 2 * c_custkey + 1", f"{USER} + c_custkey", "'Archive'"),
    ):
        own = {"seq": "0", "op_index": f"2 * ({inode})", "inode_id": inode, "inode_kind": "'directory'", "committed_by": "'system'", "committed_at_ms": "0"}
        rows.append(_row(source, delta_index=f"2 * ({inode})", kind="'create_inode'", **own))
        if parent is not None:
            rows.append(_row(source, delta_index=f"2 * ({inode}) + 1", kind="'bind_direntry'", parent_id=parent, name_key=f"lower({display})", display_name=display, **own))
    shift = "CASE WHEN seq > n // 2 AND user_id % 3 = 2 THEN seq ELSE seq - 1 END" if namespace == "fork" else "seq - 1"
    marks = "" if not with_marks else "marks AS (SELECT n, n // 4 AS floor_seq, n // 2 AS mid, 3 * n // 4 AS late, 6 * n // 10 AS s1, 8 * n // 10 AS s2, (SELECT greatest(count(*), 1) FROM documents) AS n_docs FROM (SELECT count(*) AS n FROM events)),"
    union = "\n UNION ALL ".join(rows)
    return f"""{marks}
 raw{tag} AS (SELECT event_id + 1 AS seq, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) // 1000 AS ms FROM events),
 kept{tag} AS (SELECT raw{tag}.*, {FILE} + user_id * 10 + k % 10 AS file_id, ({shift}) % n_docs AS content_id FROM raw{tag}, marks
   WHERE {_KEEP[namespace]} AND NOT (user_id % 7 = 3 AND seq >= s1 AND (user_id % 14 <> 3 OR seq <= s2))),
 numbered{tag} AS (SELECT kept{tag}.*, v.size_bytes, v.checksum, row_number() OVER (PARTITION BY file_id ORDER BY seq) AS rn FROM kept{tag} LEFT JOIN (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size_bytes, md5(coalesce(text, '')) AS checksum FROM documents) v ON v.doc_id = content_id),
 errs{tag} AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'error' AND rn > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS derr FROM numbered{tag}),
 named{tag} AS (SELECT *, CASE WHEN rn = 1 THEN 'create' WHEN event_type = 'error' THEN CASE WHEN derr % 2 = 0 THEN 'delete' ELSE 'restore' END WHEN derr % 2 = 1 THEN 'skip'
   WHEN event_type = 'click' THEN 'revise' WHEN event_type = 'purchase' THEN 'move' WHEN event_type = 'view' THEN 'describe' ELSE 'share' END AS op FROM errs{tag}),
 {ops} AS (SELECT *, CAST(count(*) FILTER (op = 'revise') OVER w AS BIGINT) AS revs, CAST(count(*) FILTER (op = 'move') OVER w AS BIGINT) AS moves, count(*) FILTER (op = 'describe') OVER w AS descriptions, count(*) FILTER (op = 'share') OVER w AS shares,
   max(CASE WHEN op = 'delete' THEN seq END) OVER (PARTITION BY file_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS deleted_seq
   FROM named{tag} WINDOW w AS (PARTITION BY file_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 deltas{tag} AS ({union}),
 binds{tag} AS (SELECT seq, delta_index, parent_id, name_key, display_name, inode_id AS child_id, inode_kind AS child_kind, kind = 'bind_direntry' AS bound FROM deltas{tag} WHERE kind IN ('bind_direntry', 'unbind_direntry')),
 inodes{tag} AS (SELECT inode_id, inode_kind, seq FROM deltas{tag} WHERE kind = 'create_inode'),
 revisions{tag} AS (SELECT inode_id, revision_no, seq, delta_index, content_id, size_bytes, checksum, committed_by, committed_at_ms FROM deltas{tag} WHERE kind = 'append_file_revision'),
 tombs{tag} AS (SELECT inode_id AS root_id, inode_kind, seq, delta_index, kind = 'tombstone_subtree' AS is_set, target_seq, committed_by, committed_at_ms FROM deltas{tag} WHERE kind IN ('tombstone_subtree', 'revoke_subtree_tombstone'))"""


def tree(at: str, tag: str = "", ledger_tag: str = "") -> str:
    """CTEs of the tree as of a sequence (an expression over marks): parents, hidden, climb, paths (visible inodes)."""
    d = ledger_tag
    return f"""parents{tag} AS (SELECT * FROM (SELECT b.*, row_number() OVER (PARTITION BY child_id ORDER BY seq DESC, delta_index DESC) AS r FROM binds{d} b, marks WHERE seq <= {at}) WHERE r = 1 AND bound),
 hidden{tag} AS (SELECT root_id FROM (SELECT t.*, row_number() OVER (PARTITION BY root_id ORDER BY seq DESC, delta_index DESC) AS r FROM tombs{d} t, marks WHERE seq <= {at}) WHERE r = 1 AND is_set),
 paths{tag}(inode_id, inode_kind, parent_id, display_name, path, key_path, depth) AS (SELECT CAST(0 AS BIGINT), 'directory', CAST(NULL AS BIGINT), '', '/', '', 0
   UNION ALL SELECT c.child_id, c.child_kind, c.parent_id, c.display_name, CASE WHEN p.depth = 0 THEN '/' || c.display_name ELSE p.path || '/' || c.display_name END, p.key_path || chr(1) || c.name_key, p.depth + 1
   FROM paths{tag} p JOIN parents{tag} c ON c.parent_id = p.inode_id WHERE c.child_id NOT IN (SELECT root_id FROM hidden{tag}))"""
