"""Registered queries: namespaces and snapshots, content ranges, coded postings, keys, planning over tables, merge execution."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..operators import content, families, grep, namespaces, postings, reads, retention, scans
from ..plans import commit, compaction, merging, ordering
from ..sources import fixture, log
from ..sources.shared import folder, stored
from . import sql
from .core import _ASKED, _REV, _SIZES, DEPTH, MID, _asked, query
from .more import _GRAMS, _MERGE, _classified, _done

# ---- namespaces and snapshots

_NS = """ns AS (SELECT 'n' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS namespace_id, 'pool' || s_nationkey AS pool_id, CASE WHEN s_acctbal < 0 THEN 'deleted' ELSE 'active' END AS state,
 CASE WHEN s_suppkey % 3 = 0 THEN 'n' || lpad(CAST(s_suppkey // 3 AS VARCHAR), 6, '0') END AS fork_of, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey END AS fork_point_seq, s_suppkey // 2 AS floor_seq, s_suppkey * 10 AS head_seq FROM supplier)"""


def _namespaces(g) -> DataFrame:
    pad = lambda c: f"concat('n', lpad(cast({c} as string), 6, '0'))"
    return fixture.table(g.spark, g.dir, "supplier").selectExpr(f"{pad('s_suppkey')} namespace_id", "concat('pool', s_nationkey) pool_id", "if(s_acctbal < 0, 'deleted', 'active') state", f"case when s_suppkey % 3 = 0 then {pad('s_suppkey div 3')} end fork_of", "case when s_suppkey % 3 = 0 then s_suppkey end fork_point_seq", "s_suppkey div 2 floor_seq", "s_suppkey * 10 head_seq")


@query("namespaces_page", f"WITH {_NS} SELECT namespace_id, pool_id, fork_of, head_seq FROM ns WHERE state = 'active' AND namespace_id > 'n000003' ORDER BY 1 LIMIT 5", None)
def _(g):
    return namespaces.page(_namespaces(g), "n000003", 5).select("namespace_id", "pool_id", "fork_of", "head_seq")


@query("namespaces_created_and_forked", f"WITH {_NS} SELECT * FROM ns UNION ALL SELECT 'x1', 'poolx', 'active', NULL, NULL, 0, 0 UNION ALL (SELECT 'x2', pool_id, 'active', namespace_id, head_seq, head_seq, head_seq FROM ns WHERE state = 'active' ORDER BY namespace_id LIMIT 1)", None)
def _(g):
    rows = _namespaces(g)
    first = namespaces.page(rows, limit=1).first()
    rows = namespaces.create(rows, "x1", "poolx")
    return namespaces.fork(rows, first["namespace_id"], "x2", first["head_seq"])


@query("namespaces_retired", f"WITH {_NS} SELECT namespace_id FROM ns WHERE state = 'deleted' AND namespace_id NOT IN (SELECT fork_of FROM ns WHERE state = 'active' AND fork_of IS NOT NULL)", None)
def _(g):
    return namespaces.retired(_namespaces(g)).select("namespace_id")


def _both(g) -> DataFrame:
    return g.deltas("main").withColumn("namespace_id", F.lit("main")).unionByName(g.deltas("fork").withColumn("namespace_id", F.lit("fork")))


_TWO = f"WITH RECURSIVE {sql.ledger('main')}, {sql.ledger('fork', '_f', False)}, two AS (SELECT 'main' AS namespace_id, * FROM deltas UNION ALL SELECT 'fork', * FROM deltas_f)"
_FAMILY = "CASE kind WHEN 'create_inode' THEN 'inodes' WHEN 'bind_direntry' THEN 'bindings' WHEN 'unbind_direntry' THEN 'bindings' WHEN 'append_file_revision' THEN 'revisions' WHEN 'tombstone_subtree' THEN 'tombstones' WHEN 'revoke_subtree_tombstone' THEN 'tombstones' WHEN 'append_attributes_revision' THEN 'attributes' ELSE 'access' END"


@query("namespace_statistics", f"{_TWO} SELECT namespace_id, {_FAMILY} AS family, count(*) AS rows, CAST(sum(coalesce(size_bytes, 0)) AS BIGINT) AS content_bytes, max(seq) AS last_seq FROM two GROUP BY ALL", None)
def _(g):
    return namespaces.statistics(_both(g))


@query("lineage_rows", f"{_TWO} SELECT 'main' AS reader, kind, count(*) AS n FROM deltas GROUP BY ALL UNION ALL SELECT 'fork', kind, count(*) FROM two, marks WHERE (namespace_id = 'main' AND seq <= mid) OR (namespace_id = 'fork' AND seq > mid) GROUP BY ALL", None)
def _(g):
    rows = g.spark.createDataFrame([("main", "p", "active", None, None, 0, g.m["n"]), ("fork", "p", "active", "main", g.m["mid"], g.m["mid"], g.m["n"])], namespaces.NAMESPACES)
    return namespaces.lineage(rows, _both(g)).groupBy("reader", "kind").agg(F.count("*").alias("n"))


_SNAPS = "SELECT 'n' || (c_custkey % 5) AS namespace_id, 's' || c_custkey AS snapshot_id, c_custkey * 10 AS seq, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 1000 END AS expires_ms FROM customer"


def _snapshots(g) -> DataFrame:
    return fixture.table(g.spark, g.dir, "customer").selectExpr("concat('n', c_custkey % 5) namespace_id", "concat('s', c_custkey) snapshot_id", "c_custkey * 10 seq", "case when c_custkey % 3 <> 0 then c_custkey % 1000 end expires_ms")


@query("snapshot_pins", f"SELECT namespace_id, min(seq) AS pinned_seq FROM ({_SNAPS}) WHERE (expires_ms IS NULL OR expires_ms > 100) AND snapshot_id <> 's3' GROUP BY ALL", None)
def _(g):
    return namespaces.oldest_pins(namespaces.unpinned(_snapshots(g), "n3", "s3"), 100)


@query("snapshots_changed", f"SELECT namespace_id, snapshot_id, seq, CASE WHEN snapshot_id = 's101' THEN greatest(expires_ms, 5000) ELSE expires_ms END AS expires_ms FROM ({_SNAPS}) UNION ALL SELECT 'n1', 'own', 7, NULL", None)
def _(g):
    rows = namespaces.pin(_snapshots(g), "n1", "own", 7, 5, 9)
    return namespaces.extended(rows, "n1", "s101", 5000, 0)


# ---- content


@query("read_content_range", f"SELECT r.inode_id, r.revision_no, r.size_bytes, substr(hex(encode(body)), 21, 40) AS data FROM (SELECT v.* FROM revisions v JOIN rev USING (inode_id, revision_no)) r JOIN ({_SIZES}) c ON c.content_id = r.content_id WHERE r.inode_id % 3 = 0", _REV)
def _(g):
    ids = families.inodes(g.deltas()).where("inode_kind = 'file' and inode_id % 3 = 0").select("inode_id")
    return content.read_range(g.view(), g.contents(), ids, 10, 20).withColumn("data", F.hex("data"))


@query("bloom_filter", "SELECT count(*) AS keys, 0 AS missed, true AS few_false FROM (SELECT DISTINCT content_id FROM revisions, marks WHERE seq <= mid)")
def _(g):
    keys = stored(families.revisions(g.deltas()).where(F.col("seq") <= g.m["mid"]).select("content_id").distinct(), "keys")
    n = keys.count()
    bits = content.bloom_bits(n)
    words = stored(content.bloom_filter(keys, "content_id", bits), "bloom")
    missed = content.may_contain(keys, "content_id", words, bits).where("not may_contain").agg(F.count("*").alias("missed"))
    others = g.spark.range(10_000).select((F.col("id") + 10**12).alias("content_id"))
    false_hits = content.may_contain(others, "content_id", words, bits).where("may_contain").agg((F.count("*") < 500).alias("few_false"))
    return g.spark.createDataFrame([(n,)], "keys bigint").crossJoin(missed).crossJoin(false_hits)  # one row each


# ---- the search index


@query("coded_postings", f"SELECT gram, count(*) AS n_contents, min(content_id) AS first_content, max(content_id) AS last_content FROM ({_GRAMS}) GROUP BY gram", None)
def _(g):
    values = stored(postings.value_table(g.contents()), "values")
    run = stored(postings.coded_run(grep.postings(g.contents()), values), "run")
    return postings.read_run(run, values).groupBy("gram").agg(F.count("*").alias("n_contents"), F.min("content_id").alias("first_content"), F.max("content_id").alias("last_content"))


@query("value_ordinals", f"SELECT content_id, size_bytes, row_number() OVER (ORDER BY content_id, size_bytes) - 1 AS ordinal FROM ({_SIZES})", None)
def _(g):
    return postings.value_table(g.contents())


_KEPT = "kept_values AS (SELECT content_id FROM revisions, marks WHERE seq > floor_seq AND seq <= mid UNION SELECT content_id FROM (SELECT * FROM revisions, marks WHERE seq <= floor_seq QUALIFY row_number() OVER (PARTITION BY inode_id ORDER BY revision_no DESC) = 1))"


@query("index_reorganized_and_pruned", f"SELECT gram, count(*) AS n_contents FROM ({_GRAMS}) WHERE content_id IN (SELECT content_id FROM kept_values) GROUP BY gram", _KEPT)
def _(g):
    runs = []
    for k in (0, 1):  # two runs that share some values
        c = g.contents().where("content_id % 2 = 1" if k else "content_id % 2 = 0 or content_id % 3 = 0")
        values = stored(postings.value_table(c), "values")
        runs.append((stored(postings.coded_run(grep.postings(c), values), "run"), values))
    kept = postings.retained_values(families.revisions(g.deltas()), g.m["mid"], g.m["floor"])
    run, values = postings.reorganized(runs, kept)
    values = stored(values, "values")
    return postings.read_run(stored(run, "run"), values).groupBy("gram").agg(F.count("*").alias("n_contents"))


@query("re_referenced_values", f"SELECT DISTINCT content_id FROM revisions, marks WHERE seq > mid AND content_id NOT IN (SELECT content_id FROM kept_values)", _KEPT)
def _(g):
    r = families.revisions(g.deltas())
    every = g.contents().select("content_id", "size_bytes")
    kept = postings.retained_values(r, g.m["mid"], g.m["floor"])
    return postings.referenced_again(r, g.m["mid"], every, every.join(kept, ["content_id", "size_bytes"], "left_semi")).select("content_id")


# ---- keys and numbers


@query("row_keys", "SELECT inode_id, revision_no, 'revision-' || lpad(CAST(inode_id AS VARCHAR), 20, '0') || '-' || lpad(CAST(9223372036854775807 - revision_no AS VARCHAR), 20, '0') AS row_key FROM revisions")
def _(g):
    return families.revisions(g.deltas()).select("inode_id", "revision_no", names.row_key("revision", F.col("inode_id"), F.col("revision_no")).alias("row_key"))


@query("next_ordinals", "SELECT inode_id, max(revision_no) + 1 AS next_revision FROM revisions GROUP BY inode_id")
def _(g):
    return families.revisions(g.deltas()).groupBy("inode_id").agg(F.max("revision_no").alias("n")).select("inode_id", names.next_ordinal(F.col("n")).alias("next_revision"))


@query("binding_tokens", "SELECT child_id, 'all' AS namespace, seq, delta_index FROM binds")
def _(g):
    b = families.bindings(g.deltas()).select("child_id", names.binding_version(F.lit("all"), F.col("seq"), F.col("delta_index")).alias("token"))
    return b.select("child_id", names.binding_position(F.col("token")).alias("p")).select("child_id", "p.namespace", "p.seq", "p.delta_index")


# ---- planning


@query("preconditions_over_tables", f"SELECT a.path, 'path_absence' AS kind, p.inode_id IS NULL AS holds FROM {_ASKED} a LEFT JOIN paths p ON lower(p.path) = lower(a.path) UNION ALL SELECT a.path, 'file_revision', coalesce(r.revision_no, 0) = 1 FROM {_ASKED} a JOIN paths p ON lower(p.path) = lower(a.path) LEFT JOIN rev r USING (inode_id)", MID + ", " + _REV)
def _(g):
    """Checked together against the namespace as it is at mid."""
    paths = stored(_asked(g), "paths")
    found = g.view().resolve(paths).select("path", "inode_id")
    absence = paths.select("path", F.lit("path_absence").alias("kind"), F.lit(None).cast("bigint").alias("inode_id"), F.lit(None).cast("bigint").alias("revision_no"))
    revision = paths.join(found, "path").select("path", F.lit("file_revision").alias("kind"), "inode_id", F.lit(1).cast("bigint").alias("revision_no"))
    return commit.holding(g.deltas(), g.m["mid"], absence.unionByName(revision), DEPTH).select("path", "kind", "holds")


@query("planned_attributes", f"SELECT p.inode_id, coalesce(t.attributes_revision_no, 0) + 1 AS attributes_revision_no, CASE WHEN t.attributes IS NULL THEN 'new=1' WHEN starts_with(t.attributes, 'even') THEN t.attributes || ';new=1' ELSE t.attributes || ';new=1' END AS attributes FROM (SELECT * FROM paths WHERE inode_kind = 'file' ORDER BY inode_id LIMIT 40) p LEFT JOIN att t USING (inode_id)", MID + ", " + _REV)
def _(g):
    ids = [r["inode_id"] for r in g.view().files().select("inode_id").orderBy("inode_id").limit(40).collect()]
    t = commit.Tree.load(g.deltas(), g.m["mid"], of=g.spark.createDataFrame([(i,) for i in ids], "inode_id bigint"))
    rows = commit.plan(t, [{"kind": "update_attributes", "inode_id": i, "set": {"new": "1"}} for i in ids])
    return g.spark.createDataFrame([tuple(r.values()) for r in rows], fixture.S.DELTAS).select("inode_id", "attributes_revision_no", "attributes")


@query("window_placement", "SELECT * FROM (VALUES (0, 0, 4, 'base', true, 99), (1, 2, 5, 'delta', false, 50), (2, 1, 4, 'delta', false, 40), (3, NULL, NULL, NULL, NULL, NULL)) v(case_no, first, past, tier, drops_rows, seq)", None)
def _(g):
    cases = [([300, 90, 100, 110, 2], 4, False), ([400, 40, 2, 1, 1], 8, False), ([400, 40, 30, 1], 8, False), ([300, 20, 1], 2, False)]
    rows = []
    for i, (sizes, deltas, first) in enumerate(cases):
        w = compaction.window(sizes, deltas, first)
        rows.append((i, w.start, w.stop, *compaction.placement(w, [10 * (k + 1) for k in range(len(sizes))], 99)) if w else (i, *[None] * 5))
    return g.spark.createDataFrame(rows, "case_no bigint, first bigint, past bigint, tier string, drops_rows boolean, seq bigint")


@query("floor_advanced", "SELECT * FROM (SELECT 'head' AS asked, greatest(floor_seq, least(n, (SELECT max(event_id) + 1 FROM events WHERE epoch_us(ts) // 1000 <= (SELECT max(epoch_us(ts)) // 1000 FROM events) - 86400000))) AS floor_seq FROM marks UNION ALL SELECT 'seq', mid FROM marks UNION ALL SELECT 'back', floor_seq FROM marks)", "")
def _(g):
    ev, m = g.commits(), g.m
    now = ev.agg(F.max("committed_at_ms")).first()[0]
    rows = [("head", retention.advanced_floor(ev, m["floor"], m["n"], now)), ("seq", retention.advanced_floor(ev, m["floor"], m["n"], now + 10**9, m["mid"])), ("back", retention.advanced_floor(ev, m["floor"], m["n"], now, 1))]
    return g.spark.createDataFrame(rows, "asked string, floor_seq bigint")


@query("floor_refusals", "SELECT * FROM (VALUES ('view', true), ('feed', true), ('diff', true), ('view_at_floor', false)) v(read, refused)", None)
def _(g):
    from ..operators import changes

    floor = g.m["floor"]

    def refused(f) -> bool:
        try:
            f()
        except reads.BelowRetentionFloor:
            return True
        return False

    rows = [("view", refused(lambda: reads.View(g.deltas(), floor - 1, floor=floor))), ("feed", refused(lambda: changes.feed(g.deltas(), floor - 1, 10, floor=floor))), ("diff", refused(lambda: changes.diff(g.deltas(), floor - 1, floor, floor=floor))), ("view_at_floor", refused(lambda: reads.View(g.deltas(), floor, floor=floor)))]
    return g.spark.createDataFrame(rows, "read string, refused boolean")


# ---- merge execution

_HOLDERS = "named AS (SELECT DISTINCT p.inode_id FROM plan p JOIN parents_t h ON h.parent_id = p.oep AND h.name_key = p.oek WHERE p.conflict IS NULL AND p.action IN ('create', 'restore', 'move', 'move_update') AND h.child_id <> p.inode_id AND h.child_id NOT IN (SELECT inode_id FROM plan WHERE conflict IS NULL AND action IN ('delete', 'move', 'move_update')))"


@query("merge_execution", f"{_MERGE}, {_HOLDERS} SELECT inode_id, unnest(CASE action WHEN 'move_update' THEN ['move', 'update'] ELSE [action] END) AS action FROM plan WHERE conflict IS NULL AND action <> 'none' AND inode_id NOT IN (SELECT inode_id FROM named)", None)
def _(g):
    plan = stored(merging.free_of_conflicts(stored(_classified(g), "plan"), g.deltas("main"), g.m["n"]), "plan")
    return merging.execution(plan, g.deltas("main"), g.m["n"]).where("action <> 'park'").select("inode_id", "action")


@query("merge_session_sides", f"{_MERGE} SELECT inode_id, conflict AS reason FROM plan WHERE conflict = 'content' AND inode_id % 2 = 1", None)
def _(g):
    """Every other conflict is decided for the fork; what is left out of those whose content conflicts."""
    m = g.m
    answer = lambda c: c.select("inode_id", F.when(F.col("inode_id") % 2 == 0, "ours").otherwise("theirs").alias("side"))
    done, left_out = merging.session(g.deltas("fork"), g.deltas("main"), m["mid"], m["n"], m["n"], m["mid"], answer, DEPTH)
    both = left_out.join(done.select("inode_id"), "inode_id", "left_semi")
    if not both.isEmpty():
        raise AssertionError("an inode is both merged and left out")
    return left_out.where("reason = 'content'").select("inode_id", "reason")


@query("order_respects_waits", "SELECT 0 AS violations, count(*) AS operations FROM customer", None)
def _(g):
    """A chain of renames and swaps over all customers: no operation takes a name that is still held."""
    ids = [r[0] for r in fixture.table(g.spark, g.dir, "customer").select("c_custkey").orderBy("c_custkey").collect()]
    held = {(i % 7, f"n{i}"): i for i in ids}
    ring = {a: b for a, b in zip(ids, ids[1:] + ids[:1], strict=True)}
    changes = {a: {"action": "move", "parent": b % 7, "name": f"n{b}"} for a, b in ring.items()}
    done, wrong, now, where = ordering.ordered(changes, held), 0, dict(held), {i: k for k, i in held.items()}
    for c in done:
        wrong += now.get((c["parent"], c["name"]), c["inode_id"]) != c["inode_id"]
        now.pop(where[c["inode_id"]], None)
        now[c["parent"], c["name"]] = c["inode_id"]
        where[c["inode_id"]] = (c["parent"], c["name"])
    return g.spark.createDataFrame([(wrong, sum(c["action"] == "move" for c in done))], "violations bigint, operations bigint")


# ---- search on whole texts


@query("grep_over_lines", f"WITH l AS (SELECT content_id, line, line_no, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY content_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, lead(line) OVER (PARTITION BY content_id ORDER BY line_no) AS next FROM (SELECT content_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS line_no FROM ({_SIZES}))) SELECT content_id, CAST(line_no AS BIGINT) AS line_no, CAST(before + strlen(line) - 1 AS BIGINT) AS byte_offset, strlen(line) > 512 AS line_truncated FROM l WHERE ends_with(line, '.') AND starts_with(next, 'T')", None)
def _(g):
    return grep.grep(g.contents(), grep.postings(g.contents()), r"\.\nT").select("content_id", "line_no", "byte_offset", "line_truncated")


# ---- scans of stored families


def _run(g) -> dict[str, DataFrame]:
    path = f"{folder(g.spark)}/run-{uuid.uuid4().hex}"
    log.write_run({"revisions": families.revisions(g.deltas()).where(F.col("seq") <= g.m["mid"])}, path)
    return {"revisions": g.spark.read.parquet(f"{path}/revisions")}


@query("scan_range_page", "SELECT inode_id, revision_no, seq FROM revisions, marks WHERE seq <= mid AND inode_id >= 4000000000100 AND inode_id < 4000000000900 ORDER BY inode_id, revision_no LIMIT 40")
def _(g):
    return scans.scan_range(_run(g)["revisions"], "inode_id", 4_000_000_000_100, 4_000_000_000_900, 40, ["revision_no"]).select("inode_id", "revision_no", "seq")


@query("find_row", "SELECT inode_id, revision_no, seq, content_id FROM revisions, marks WHERE seq <= mid AND revision_no = 1 AND inode_id = (SELECT min(inode_id) FROM revisions, marks WHERE seq <= mid)")
def _(g):
    rows = _run(g)["revisions"]
    return scans.find_row(rows, inode_id=rows.agg(F.min("inode_id")).first()[0], revision_no=1).select("inode_id", "revision_no", "seq", "content_id")


@query("base_and_tail", "SELECT inode_id, revision_no, seq FROM revisions")
def _(g):
    tail = families.revisions(g.deltas()).where(F.col("seq") > g.m["floor"])  # the tail begins before what is folded
    return scans.combined(_run(g)["revisions"], tail, g.m["mid"], scans.KEYS["revisions"]).select("inode_id", "revision_no", "seq")


@query("receipts", "SELECT 'c' || (event_id + 1) AS commit_id, event_id + 1 AS seq FROM events WHERE event_id = 16", None)
def _(g):
    again = g.commits().where("commit_id = 'c17'").withColumn("seq", F.col("seq") + 10**6)
    return scans.receipt(g.commits().unionByName(again), "c17").select("commit_id", "seq")


@query("newest_merges", "SELECT 'f' || (event_id % 4) AS source, max(event_id) + 1 AS seq, max(event_id) AS source_through_seq FROM events WHERE event_id % 97 = 0 GROUP BY 1", None)
def _(g):
    return scans.newest_merges(_done(g)).select("source", "seq", "source_through_seq")


@query("commits_after_budget", "SELECT seq, size_bytes FROM (SELECT *, sum(size_bytes) OVER (ORDER BY seq) AS total FROM (SELECT event_id + 1 AS seq, strlen(props) AS size_bytes FROM events, marks WHERE event_id + 1 > mid ORDER BY 1 LIMIT 200)) WHERE total <= 1000", "")
def _(g):
    rows = fixture.table(g.spark, g.dir, "events").select((F.col("event_id") + 1).alias("seq"), F.octet_length("props").cast("bigint").alias("size_bytes"))
    return scans.commits_after(rows, g.m["mid"], 200, 1000).select("seq", "size_bytes")
