"""A legal ledger derived from the star-schema tables: one commit per event.

Root -> region -> nation -> customer -> ``inbox`` and ``archive`` -> files. A file's events, in order, create, revise, move,
describe, share, delete and restore it; every seventh customer's directory is deleted at 60 % of the events and half of those
come back at 80 %. All counters are window sums over one file, so the ledger is built without recursion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S

NATION, USER, FOLDER, FILE, OTHER = 1_000, 1_000_000_000, 2_000_000_000_000, 4_000_000_000_000, 9_000_000_000_000
#: Events that a namespace keeps: a condition on seq, user_id and n (number of events).
NAMESPACES = {"all": "true", "main": "seq <= n div 2 or user_id % 3 in (1, 2)", "fork": "seq <= n div 2 or user_id % 3 in (0, 2)"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def marks(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """n events, and the sequences that queries use: floor, mid (also fork point), late, deletion and revocation."""
    n = table(spark, sf_dir, "events").count()
    return {"n": n, "floor": n // 4, "mid": n // 2, "late": 3 * n // 4, "s1": 6 * n // 10, "s2": 8 * n // 10}


def operations(spark: SparkSession, sf_dir: str, namespace: str = "all") -> DataFrame:
    """One row per event with its operation and the file's counters."""
    m = marks(spark, sf_dir)
    docs = table(spark, sf_dir, "documents")
    n_docs = max(1, docs.count())
    ms = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    ev = table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("seq"), "user_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"), ms.alias("committed_at_ms"))
    ev = ev.where(F.expr(NAMESPACES[namespace].replace("n div", f"{m['n']} div")))
    ev = ev.where(f"not (user_id % 7 = 3 and seq >= {m['s1']} and (user_id % 14 <> 3 or seq <= {m['s2']}))")
    shift = F.when((F.lit(namespace == "fork")) & (F.col("seq") > m["mid"]) & (F.col("user_id") % 3 == 2), F.col("seq")).otherwise(F.col("seq") - 1)
    ev = ev.withColumn("file_id", FILE + F.col("user_id") * 10 + F.col("k") % 10).withColumn("content_id", shift % n_docs)
    w = Window.partitionBy("file_id").orderBy("seq")
    upto, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    ev = ev.withColumn("rn", F.row_number().over(w))
    ev = ev.withColumn("derr", F.coalesce(F.sum(F.expr("cast(event_type = 'error' and rn > 1 as bigint)")).over(ahead), F.lit(0)))
    op = F.expr("""case when rn = 1 then 'create'
        when event_type = 'error' then if(derr % 2 = 0, 'delete', 'restore')
        when derr % 2 = 1 then 'skip'
        else element_at(map('click', 'revise', 'purchase', 'move', 'view', 'describe', 'signup', 'share'), event_type) end""")
    ev = ev.withColumn("op", op)
    for name, kind in (("revs", "revise"), ("moves", "move"), ("descriptions", "describe"), ("shares", "share")):
        ev = ev.withColumn(name, F.sum((F.col("op") == kind).cast("bigint")).over(upto))
    body = F.coalesce("text", F.lit(""))
    values = docs.select(F.col("doc_id").alias("content_id"), F.octet_length(body).cast("bigint").alias("size_bytes"), F.md5(body.cast("binary")).alias("checksum"))
    ev = ev.join(values, "content_id", "left")
    return ev.withColumn("deleted_seq", F.last(F.when(F.col("op") == "delete", F.col("seq")), ignorenulls=True).over(ahead))


def _delta(index: str, kind: str, **given: str) -> str:
    own = {"delta_index": index, "kind": f"'{kind}'"} | given
    return "named_struct(" + ", ".join(f"'{c}', cast({own.get(c, 'null')} as {t})" for c, t in S.DELTA_COLUMNS.items() if c not in ("seq", "op_index", "committed_by", "committed_at_ms")) + ")"


#: The maps of a description and of a share, of the event's number k.
ATTRIBUTES = "if(k % 2 = 0, map('k', cast(k as string), 'even', 'yes'), map('k', cast(k as string)))"
GRANTS = "if(k % 3 = 0, map(concat('p', k % 4), 1 + k % 127, concat('p', (k + 1) % 4), 1 + 7 * k % 127), map(concat('p', k % 4), 1 + k % 127))"


ROOT_GRANTS = "map('p0', 255, 'p9', 1, 'root', 128)"


def _name(moves: str) -> str:
    return f"concat('F', k % 10, if({moves} > 0, concat('-M', {moves}), ''), '.txt')"


def _folder(moves: str) -> str:
    return f"{FOLDER} + 2 * user_id + {moves} % 2"


def deltas(spark: SparkSession, sf_dir: str, namespace: str = "all") -> DataFrame:
    """The ledger, one row per delta."""
    m = marks(spark, sf_dir)
    who = {"inode_id": "file_id", "inode_kind": "'file'"}

    def edge(index: str, kind: str, moves: str) -> str:
        return _delta(index, kind, parent_id=_folder(moves), name_key=f"lower({_name(moves)})", display_name=_name(moves), **who)

    by_op = {
        "create": [_delta("0", S.CREATE, **who), edge("1", S.BIND, "0"), _delta("2", S.REVISE, revision_no="1", content_id="content_id", size_bytes="size_bytes", checksum="checksum", **who)],
        "revise": [_delta("0", S.REVISE, revision_no="1 + revs", content_id="content_id", size_bytes="size_bytes", checksum="checksum", **who)],
        "move": [edge("0", S.UNBIND, "(moves - 1)"), edge("1", S.BIND, "moves")],
        "describe": [_delta("0", S.ATTRIBUTES, attributes_revision_no="descriptions", attributes=ATTRIBUTES, **who)],
        "share": [_delta("0", S.ACCESS, access_revision_no="shares", boundary="k % 5 = 0", grants=GRANTS, **who)],
        "delete": [edge("0", S.UNBIND, "moves"), _delta("1", S.DELETE, **who)],
        "restore": [_delta("0", S.REVOKE, target_seq="deleted_seq", **who), edge("1", S.BIND, "moves")],
    }
    cases = " ".join(f"when '{op}' then array({', '.join(parts)})" for op, parts in by_op.items())
    files = operations(spark, sf_dir, namespace).where("op <> 'skip'").selectExpr("seq", "cast(0 as bigint) op_index", f"inline(case op {cases} end)", "concat('usr_', user_id) committed_by", "committed_at_ms")

    users = table(spark, sf_dir, "customer").selectExpr("c_custkey user_id", "c_nationkey")
    folder = {"inode_kind": "'directory'"}

    def user_edge(index: str, kind: str) -> str:
        return _delta(index, kind, inode_id=f"{USER} + user_id", parent_id=f"{NATION} + c_nationkey", name_key="concat('user_', user_id)", display_name="concat('User_', user_id)", **folder)

    def whole(at: int, condition: str, first: str, second: str) -> DataFrame:
        time = table(spark, sf_dir, "events").where(f"event_id + 1 = {at}").selectExpr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) committed_at_ms", "concat('usr_', user_id) committed_by")
        return users.where(condition).crossJoin(F.broadcast(time)).selectExpr(f"cast({at} as bigint) seq", "1 + user_id op_index", f"inline(array({first}, {second}))", "committed_by", "committed_at_ms")  # one row on the right

    user = {"inode_id": f"{USER} + user_id", **folder}
    parts = [
        files,
        whole(m["s1"], "user_id % 7 = 3", user_edge("1000 + 2 * user_id", S.UNBIND), _delta("1001 + 2 * user_id", S.DELETE, **user)),
        whole(m["s2"], "user_id % 14 = 3", _delta("1000 + 2 * user_id", S.REVOKE, target_seq=str(m["s1"]), **user), user_edge("1001 + 2 * user_id", S.BIND)),
    ]

    if namespace == "fork":  # directories that only the fork moves, to the next nation
        edge = {"name_key": "concat('user_', user_id)", "display_name": "concat('User_', user_id)"} | user
        away = f"{NATION} + (c_nationkey + 1) % 25"
        parts.append(whole(m["late"], "user_id % 11 = 5 and user_id % 7 <> 3", _delta("1000 + 2 * user_id", S.UNBIND, parent_id=f"{NATION} + c_nationkey", **edge), _delta("1001 + 2 * user_id", S.BIND, parent_id=away, **edge)))
    if namespace == "main":  # directories that only the target has, some where the fork moves one to
        new = {"inode_id": f"{OTHER} + user_id", **folder}
        parts.append(whole(m["late"], "user_id % 33 = 27", _delta("1000 + 2 * user_id", S.CREATE, **new), _delta("1001 + 2 * user_id", S.BIND, parent_id=f"{NATION} + (c_nationkey + 1) % 25", name_key="concat('user_', user_id)", display_name="concat('User_', user_id)", **new)))

    def genesis(rows: DataFrame, inode: str, parent: str | None, display: str) -> DataFrame:
        own = {"inode_id": inode, **folder}
        both = [_delta(f"2 * ({inode})", S.CREATE, **own)]
        if parent is not None:
            both.append(_delta(f"2 * ({inode}) + 1", S.BIND, parent_id=parent, name_key=f"lower({display})", display_name=display, **own))
        return rows.selectExpr("cast(0 as bigint) seq", f"2 * ({inode}) op_index", f"inline(array({', '.join(both)}))", "'system' committed_by", "cast(0 as bigint) committed_at_ms")

    parts.append(spark.range(1).selectExpr("cast(0 as bigint) seq", "cast(1 as bigint) op_index", f"inline(array({_delta('1', S.ACCESS, inode_id=str(S.ROOT), access_revision_no='1', boundary='false', grants=ROOT_GRANTS, **folder)}))", "'system' committed_by", "cast(0 as bigint) committed_at_ms"))
    parts += [
        genesis(spark.range(1), "cast(0 as bigint)", None, ""),
        genesis(table(spark, sf_dir, "region"), "1 + r_regionkey", str(S.ROOT), "r_name"),
        genesis(table(spark, sf_dir, "nation"), f"{NATION} + n_nationkey", "1 + n_regionkey", "n_name"),
        genesis(users, f"{USER} + user_id", f"{NATION} + c_nationkey", "concat('User_', user_id)"),
        genesis(users, f"{FOLDER} + 2 * user_id", f"{USER} + user_id", "'Inbox'"),
        genesis(users, f"{FOLDER} + 2 * user_id + 1", f"{USER} + user_id", "'Archive'"),
    ]
    out = parts[0].select(*S.DELTA_COLUMNS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*S.DELTA_COLUMNS))
    return out


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """content_id, size_bytes, body."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("content_id"), F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("size_bytes"), F.coalesce("text", F.lit("")).alias("body"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commit per event, and the first one: seq, commit_id, committed_by, committed_at_ms, fingerprint."""
    ev = table(spark, sf_dir, "events").selectExpr("event_id + 1 seq", "concat('c', event_id + 1) commit_id", "concat('usr_', user_id) committed_by", "timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) committed_at_ms", "md5(concat(user_id, '|', event_type, '|', props)) fingerprint")
    return ev.unionByName(spark.range(1).selectExpr("cast(0 as bigint) seq", "'c0' commit_id", "'system' committed_by", "cast(0 as bigint) committed_at_ms", "md5('genesis') fingerprint"))
