"""Registered queries over the fixture ledger, each with its oracle.

A query takes (spark, sf_dir). The oracle's ledger is built another way (``sql.ledger``), and its trees by recursion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes, families, reads, retention, stats, tree
from ..operators.asof import asof_join, intervals
from ..sources import fixture
from ..sources.shared import remains, stored
from . import sql

DEPTH = fixture.S.MAX_DEPTH
_STORED: dict[tuple, DataFrame] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Ledger:
    """The fixture ledger of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir, self.m = spark, sf_dir, fixture.marks(spark, sf_dir)

    def deltas(self, namespace: str = "all") -> DataFrame:
        """The log as stored, in a folder a kind: made once an application, and filters on kind and seq reach the files."""
        key = (self.spark.sparkContext.applicationId, self.dir, namespace)
        if key not in _STORED or not remains(_STORED[key]):
            _STORED[key] = stored(fixture.deltas(self.spark, self.dir, namespace), f"log-{namespace}", ["kind"])
        return _STORED[key]

    def view(self, mark: str = "mid") -> reads.View:
        return reads.View(self.deltas(), self.m[mark], DEPTH)

    def contents(self) -> DataFrame:
        return fixture.contents(self.spark, self.dir)

    def commits(self) -> DataFrame:
        return fixture.commits(self.spark, self.dir)


def _plain(df: DataFrame) -> DataFrame:
    """Integers as bigint and maps as text, as the oracle has them."""
    return df.select(*(F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else families.told(c).alias(c) if t.startswith("map<") else F.col(c) for c, t in df.dtypes))


def query(name: str, oracle: str | None = None, ctes: str | None = ""):
    """Registers a query; ctes: further CTEs after the ledger's, or None for an oracle without the ledger."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: _plain(f(Ledger(spark, sf_dir)))
        if oracle:
            ORACLES[name] = oracle if ctes is None else f"WITH RECURSIVE {sql.ledger()}{', ' + ctes if ctes else ''} {oracle}"
        return f

    return put


MID, LATE = sql.tree("mid"), sql.tree("late", "_b")
#: The newest row per key, the oracle's way.
PICK = "QUALIFY row_number() OVER (PARTITION BY {} ORDER BY seq DESC, delta_index DESC) = 1"


# ---- ledger and families

@query("ledger_deltas", f"SELECT {', '.join(fixture.S.DELTA_COLUMNS)} FROM deltas")
def _(g):
    return g.deltas()


@query("family_inodes", "SELECT inode_id, inode_kind, seq FROM inodes")
def _(g):
    return families.inodes(g.deltas()).select("inode_id", "inode_kind", "seq")


@query("family_bindings", "SELECT parent_id, name_key, child_id, seq, delta_index, bound, display_name FROM binds")
def _(g):
    return families.bindings(g.deltas()).select("parent_id", "name_key", "child_id", "seq", "delta_index", "bound", "display_name")


@query("family_revisions", "SELECT inode_id, revision_no, seq, content_id, size_bytes, checksum, committed_by, committed_at_ms FROM revisions")
def _(g):
    return families.revisions(g.deltas()).select("inode_id", "revision_no", "seq", "content_id", "size_bytes", "checksum", "committed_by", "committed_at_ms")


@query("family_tombstones", "SELECT root_id, inode_kind, seq, is_set, target_seq FROM tombs")
def _(g):
    return families.tombstones(g.deltas()).select("root_id", "inode_kind", "seq", "is_set", "target_seq")


@query("family_trash", "SELECT root_id, CASE WHEN is_set THEN seq ELSE target_seq END AS deletion_seq, CASE WHEN is_set THEN 'listed' ELSE 'removed' END AS action FROM tombs")
def _(g):
    return families.trash_rows(g.deltas()).select("root_id", "deletion_seq", "action")


@query("family_attributes", "SELECT inode_id, attributes_revision_no, seq, attributes FROM deltas WHERE kind = 'append_attributes_revision'")
def _(g):
    return families.attributes(g.deltas()).select("inode_id", "attributes_revision_no", "seq", "attributes")


@query("family_access", "SELECT inode_id, access_revision_no, seq, boundary, grants FROM deltas WHERE kind = 'append_access_revision'")
def _(g):
    return families.access(g.deltas()).select("inode_id", "access_revision_no", "seq", "boundary", "grants")


@query("family_commits", "SELECT 0 AS seq, 'c0' AS commit_id, 'system' AS committed_by, 0 AS committed_at_ms UNION ALL SELECT event_id + 1, 'c' || (event_id + 1), 'usr_' || user_id, epoch_us(ts) // 1000 FROM events", None)
def _(g):
    return g.commits().select("seq", "commit_id", "committed_by", "committed_at_ms")


@query("asof_slots", f"SELECT parent_id, name_key, child_id, bound FROM binds, marks WHERE seq <= mid {PICK.format('parent_id, name_key')}")
def _(g):
    return tree.slots(g.deltas(), g.m["mid"]).select("parent_id", "name_key", "child_id", "bound")


@query("asof_parents", "SELECT child_id, parent_id, name_key, display_name FROM parents", MID)
def _(g):
    return tree.parents(g.deltas(), g.m["mid"]).select("child_id", "parent_id", "name_key", "display_name")


@query("asof_join_revisions", "SELECT e.event_id, e.user_id * 10 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS slot, max(r.revision_no) AS revision_no FROM events e LEFT JOIN revisions r ON r.inode_id = 4000000000000 + e.user_id * 10 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AND r.seq <= e.event_id + 1 GROUP BY ALL")
def _(g):
    ev = fixture.table(g.spark, g.dir, "events").select("event_id", (F.col("event_id") + 1).alias("at"), (F.col("user_id") * 10 + F.get_json_object("props", "$.k").cast("bigint") % 10).alias("slot")).withColumn("inode_id", F.col("slot") + fixture.FILE)
    return asof_join(ev, families.revisions(g.deltas()).select("inode_id", "revision_no", "seq", "delta_index"), ["inode_id"], "at").select("event_id", "slot", F.col("row_revision_no").alias("revision_no"))


@query("validity_intervals", "SELECT inode_id, revision_no, seq AS valid_from, min(seq) OVER (PARTITION BY inode_id ORDER BY revision_no ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS valid_to FROM revisions")
def _(g):
    return intervals(families.revisions(g.deltas()), ["inode_id"]).select("inode_id", "revision_no", "valid_from", "valid_to")


_LISTED = "(SELECT '/' || r_name || '/' || min(n_name) FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey = 0 GROUP BY r_name)"


def _listed(g) -> str:
    """A nation's directory: the first by name in region 0."""
    t = lambda n: fixture.table(g.spark, g.dir, n)
    r = t("region").where("r_regionkey = 0").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.min("n_name").alias("n")).first()
    return f"/{r['r_name']}/{r['n']}"


@query("listdir_at", f"SELECT p.inode_id, p.inode_kind, p.display_name, p.path FROM paths p JOIN paths d ON p.parent_id = d.inode_id WHERE d.path = {_LISTED}", MID)
def _(g):
    return g.view().listdir(_listed(g).swapcase()).select("inode_id", "inode_kind", "display_name", "path")  # names are told as they are written


@query("listdir_page_keyset", f"SELECT p.display_name, p.path FROM paths p JOIN paths d ON p.parent_id = d.inode_id WHERE d.path = {_LISTED} AND lower(p.display_name) > 'user_1' ORDER BY lower(p.display_name) LIMIT 10", MID)
def _(g):
    return g.view().listdir(_listed(g), after="user_1", limit=10).select("display_name", "path")


@query("inv_one_parent", "SELECT count(*) AS violations FROM (SELECT child_id FROM (SELECT child_id, seq, delta_index, bound, lag(bound) OVER (PARTITION BY child_id ORDER BY seq, delta_index) AS was FROM binds) WHERE bound IS NOT DISTINCT FROM was)")
def _(g):
    from pyspark.sql import Window

    w = Window.partitionBy("child_id").orderBy("seq", "delta_index")
    return families.bindings(g.deltas()).withColumn("was", F.lag("bound").over(w)).where("bound <=> was").agg(F.count("*").alias("violations"))


@query("inv_one_child", "SELECT count(*) AS violations FROM (SELECT parent_id, name_key FROM parents_b GROUP BY ALL HAVING count(*) > 1)", LATE)
def _(g):
    return tree.parents(g.deltas(), g.m["late"]).groupBy("parent_id", "name_key").count().where("count > 1").agg(F.count("*").alias("violations"))


@query("inv_gapfree_revisions", "SELECT count(*) AS violations FROM (SELECT inode_id FROM revisions GROUP BY inode_id HAVING count(*) <> max(revision_no) OR min(revision_no) <> 1)")
def _(g):
    return families.revisions(g.deltas()).groupBy("inode_id").agg(F.count("*").alias("n"), F.max("revision_no").alias("hi"), F.min("revision_no").alias("lo")).where("n <> hi or lo <> 1").agg(F.count("*").alias("violations"))


@query("replay_contiguous", "SELECT count(DISTINCT event_id) AS commits, max(event_id) + 1 AS last_seq FROM events, (SELECT count(*) // 4 AS f FROM events) WHERE event_id + 1 > f AND event_id + 1 < f + f", None)
def _(g):
    log = g.commits().where(F.col("seq") != 2 * g.m["floor"])  # one commit is missing
    return retention.contiguous(log, g.m["floor"]).agg(F.count_distinct("seq").alias("commits"), F.max("seq").alias("last_seq"))


@query("merged_runs", "SELECT inode_id, revision_no, seq FROM revisions")
def _(g):
    r = families.revisions(g.deltas()).select("inode_id", "revision_no", "seq")
    m = g.m
    return retention.merged_runs([r.where(F.col("seq") <= m["mid"]), r.where((F.col("seq") > m["floor"]) & (F.col("seq") <= m["late"])), r.where(F.col("seq") > m["mid"])], ["inode_id", "revision_no"])


# ---- tree

@query("closure_at", "SELECT child_id AS inode_id, ancestor_id, depth FROM up", MID + ", up AS (SELECT inode_id AS child_id, inode_id AS ancestor_id, CAST(0 AS BIGINT) AS depth FROM inodes, marks WHERE seq <= mid UNION ALL SELECT u.child_id, p.parent_id, u.depth + 1 FROM up u JOIN parents p ON p.child_id = u.ancestor_id)")
def _(g):
    return tree.closure(g.deltas(), g.m["mid"], DEPTH)


@query("paths_at", "SELECT inode_id, inode_kind, parent_id, path, CAST(depth AS BIGINT) AS depth FROM paths", MID)
def _(g):
    return g.view().paths().select("inode_id", "inode_kind", "parent_id", "path", "depth")


@query("hidden_roots_at", f"SELECT root_id, seq AS deletion_seq FROM (SELECT * FROM tombs, marks WHERE seq <= late {PICK.format('root_id')}) WHERE is_set")
def _(g):
    return tree.hidden_roots(g.deltas(), g.m["late"]).select("root_id", "deletion_seq")


@query("visible_at", "SELECT inode_id FROM paths_b", LATE)
def _(g):
    return g.view("late").paths().select("inode_id")


@query("walk_dfs", "SELECT row_number() OVER (ORDER BY key_path) AS position, inode_id, path FROM paths", MID)
def _(g):
    from pyspark.sql import Window

    rows = g.view().paths().select("inode_id", "path", "path_keys")
    # places over all rows come from counts by nation and by user directory, and a rank within the latter
    rows = rows.withColumn("one", F.slice("path_keys", 1, 2)).withColumn("two", F.slice("path_keys", 1, 3))
    small = rows.groupBy("one", "two").agg(F.count("*").alias("n"))
    large = small.groupBy("one").agg(F.sum("n").alias("n"))
    large = large.select("one", (F.sum("n").over(Window.orderBy("one")) - F.col("n")).alias("before"))  # a row a nation
    small = small.select("one", "two", (F.sum("n").over(Window.partitionBy("one").orderBy("two")) - F.col("n")).alias("within"))
    rank = F.row_number().over(Window.partitionBy("one", "two").orderBy("path_keys"))
    return rows.join(small, ["one", "two"]).join(large, "one").select((F.col("before") + F.col("within") + rank).alias("position"), "inode_id", "path")


@query("walk_page_keyset", f"SELECT path FROM paths WHERE key_path > (SELECT key_path FROM paths WHERE path = {_LISTED}) ORDER BY key_path LIMIT 50", MID)
def _(g):
    return g.view().walk(after=[x.lower() for x in _listed(g).split("/")[1:]], limit=50).select("path")


@query("walk_scoped", f"SELECT path, CAST(depth AS BIGINT) AS depth FROM paths WHERE path = {_LISTED} OR starts_with(path, {_LISTED} || '/')", MID)
def _(g):
    return g.view().walk([x.lower() for x in _listed(g).split("/")[1:]]).select("path", "depth")


_ASKED = "(SELECT '/' || r_name || '/' || n_name || '/User_' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '/Inbox/F' ELSE '/inBOX/f' END || (c_custkey % 10) || '.txt' AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def _asked(g) -> DataFrame:
    t = lambda n: fixture.table(g.spark, g.dir, n)
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name", F.lit("/User_"), F.col("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, "/Inbox/F").otherwise("/inBOX/f"), F.col("c_custkey") % 10, F.lit(".txt")).alias("path"))


_REV = f"rev AS (SELECT inode_id, revision_no, content_id FROM revisions, marks WHERE seq <= mid {PICK.format('inode_id')}), att AS (SELECT inode_id, attributes_revision_no, attributes FROM deltas, marks WHERE kind = 'append_attributes_revision' AND seq <= mid {PICK.format('inode_id')})"


@query("resolve_paths", f"SELECT a.path, p.inode_id, p.path AS found_path FROM {_ASKED} a JOIN paths p ON lower(p.path) = lower(a.path)", MID)
def _(g):
    return g.view().resolve(_asked(g))


@query("stat_by_path", f"SELECT a.path, p.inode_id IS NOT NULL AS found, p.inode_id, r.revision_no, CASE WHEN p.inode_id IS NOT NULL THEN coalesce(t.attributes_revision_no, 0) END AS attributes_revision_no FROM {_ASKED} a LEFT JOIN paths p ON lower(p.path) = lower(a.path) LEFT JOIN rev r ON r.inode_id = p.inode_id LEFT JOIN att t ON t.inode_id = p.inode_id", MID + ", " + _REV)
def _(g):
    return g.view().stat(_asked(g)).select("path", "found", "inode_id", "revision_no", "attributes_revision_no")


_IDS = "(SELECT 4000000000000 + c_custkey * 10 + c_custkey % 10 AS inode_id FROM customer)"


def _ids(g) -> DataFrame:
    return fixture.table(g.spark, g.dir, "customer").select((fixture.FILE + F.col("c_custkey") * 10 + F.col("c_custkey") % 10).alias("inode_id"))


@query("batch_stat", f"SELECT a.inode_id, p.path, r.revision_no, CASE WHEN p.path IS NULL THEN CASE WHEN i.inode_id IS NULL THEN 'never_created' ELSE 'not_visible' END END AS missing FROM {_IDS} a LEFT JOIN paths p USING (inode_id) LEFT JOIN (SELECT rev.* FROM rev) r ON r.inode_id = p.inode_id LEFT JOIN (SELECT inode_id FROM inodes, marks WHERE seq <= mid) i ON i.inode_id = a.inode_id", MID + ", " + _REV)
def _(g):
    return g.view().stat_inodes(_ids(g)).select("inode_id", "path", "revision_no", "missing")


@query("stat_by_inode", "SELECT p.inode_id, p.path, p.inode_kind, r.revision_no FROM paths p LEFT JOIN rev r USING (inode_id)", MID + ", " + _REV)
def _(g):
    return g.view().entries().select("inode_id", "path", "inode_kind", "revision_no")


@query("cycle_check", "SELECT DISTINCT a AS child_id FROM (SELECT s_suppkey AS a, (s_suppkey * 7) % 20 + 1 AS b FROM supplier), hops WHERE hops.start = a AND hops.node = a", "hops AS (SELECT s_suppkey AS start, (s_suppkey * 7) % 20 + 1 AS node, 1 AS n FROM supplier UNION ALL SELECT start, (node * 7) % 20 + 1, n + 1 FROM hops WHERE n < 200 AND node IN (SELECT s_suppkey FROM supplier))")
def _(g):
    edges = fixture.table(g.spark, g.dir, "supplier").select(F.col("s_suppkey").alias("child_id"), ((F.col("s_suppkey") * 7) % 20 + 1).alias("parent_id"))
    return tree.cycles(edges, 128)


@query("has_children", "SELECT inode_id, inode_id IN (SELECT parent_id FROM paths WHERE parent_id IS NOT NULL) AS has_children FROM paths WHERE inode_kind = 'directory'", MID)
def _(g):
    return g.view().has_children()


# ---- history

@query("revisions_of_file", "SELECT revision_no, seq, content_id FROM revisions WHERE inode_id = (SELECT inode_id FROM revisions GROUP BY inode_id ORDER BY count(*) DESC, inode_id LIMIT 1)")
def _(g):
    r = families.revisions(g.deltas())
    busiest = r.groupBy("inode_id").count().orderBy(F.desc("count"), "inode_id").limit(1).select("inode_id")
    return r.join(busiest, "inode_id", "left_semi").orderBy(F.desc("revision_no")).select("revision_no", "seq", "content_id")


@query("retained_revisions", f"SELECT inode_id, revision_no, seq FROM revisions, marks WHERE seq > floor_seq UNION ALL SELECT inode_id, revision_no, seq FROM (SELECT * FROM revisions, marks WHERE seq <= floor_seq {PICK.format('inode_id')})")
def _(g):
    return retention.keep_whole_state(families.revisions(g.deltas()), "revision_no", g.m["floor"]).orderBy("inode_id", F.desc("revision_no")).select("inode_id", "revision_no", "seq")


@query("revision_at", "SELECT inode_id, revision_no, content_id FROM rev", _REV)
def _(g):
    return g.view().revision().select("inode_id", "revision_no", "content_id")


@query("attributes_at", "SELECT inode_id, attributes_revision_no, attributes FROM att", _REV)
def _(g):
    return g.view().attributes().select("inode_id", "attributes_revision_no", "attributes")


@query("access_at", f"SELECT inode_id, access_revision_no, boundary, grants FROM deltas, marks WHERE kind = 'append_access_revision' AND seq <= mid {PICK.format('inode_id')}")
def _(g):
    return g.view().access().select("inode_id", "access_revision_no", "boundary", "grants")


@query("trash_at_floor", "SELECT s.seq AS deletion_seq, s.root_id, s.inode_kind FROM tombs s, marks WHERE s.is_set AND s.seq > floor_seq AND s.seq <= late AND NOT EXISTS (SELECT 1 FROM tombs r WHERE NOT r.is_set AND r.root_id = s.root_id AND r.target_seq = s.seq AND r.seq <= late)")
def _(g):
    return g.view("late").trash(g.m["floor"]).select("deletion_seq", "root_id", "inode_kind")


@query("files_at", "SELECT p.inode_id, p.path, r.revision_no, r.content_id FROM paths p LEFT JOIN rev r USING (inode_id) WHERE p.inode_kind = 'file'", MID + ", " + _REV)
def _(g):
    return g.view().files()


@query("files_at_with_deleted", "SELECT i.inode_id, p.path, r.revision_no FROM inodes i CROSS JOIN marks LEFT JOIN paths p ON p.inode_id = i.inode_id LEFT JOIN rev r ON r.inode_id = i.inode_id WHERE i.inode_kind = 'file' AND i.seq <= mid", MID + ", " + _REV)
def _(g):
    return g.view().files(with_deleted=True).select("inode_id", "path", "revision_no")


_CLIMB = f"""hid AS (SELECT root_id, seq AS deletion_seq FROM (SELECT * FROM tombs, marks WHERE seq <= late {PICK.format('root_id')}) WHERE is_set),
 lastedge AS (SELECT child_id, parent_id FROM binds, marks WHERE seq <= late {PICK.format('child_id')}),
 climb AS (SELECT inode_id, inode_id AS node, CAST(0 AS BIGINT) AS d FROM inodes, marks WHERE seq <= late UNION ALL SELECT c.inode_id, e.parent_id, c.d + 1 FROM climb c JOIN lastedge e ON e.child_id = c.node WHERE c.node NOT IN (SELECT root_id FROM hid))"""


@query("inode_read_allowed", "SELECT inode_id, CASE WHEN max(deletion_seq) IS NOT NULL THEN max(deletion_seq) > any_value(floor_seq) ELSE bool_or(node = 0) END AS allowed FROM climb CROSS JOIN marks LEFT JOIN hid ON hid.root_id = node GROUP BY inode_id", _CLIMB)
def _(g):
    return tree.readable(g.deltas(), g.m["late"], g.m["floor"], DEPTH)


_RIGHTS = f"""acc AS (SELECT inode_id, boundary, grants FROM deltas, marks WHERE kind = 'append_access_revision' AND seq <= mid {PICK.format('inode_id')}),
 reach AS (SELECT inode_id, inode_id AS node FROM paths UNION ALL SELECT r.inode_id, p.parent_id FROM reach r JOIN paths p ON p.inode_id = r.node LEFT JOIN acc a ON a.inode_id = r.node WHERE p.parent_id IS NOT NULL AND NOT coalesce(a.boundary, false)),
 gr AS (SELECT inode_id, split_part(g, '=', 1) AS principal, CAST(split_part(g, '=', 2) AS BIGINT) AS rights FROM (SELECT inode_id, unnest(string_split(grants, ';')) AS g FROM acc)),
 eff AS (SELECT r.inode_id, a.principal, bit_or(a.rights & CASE WHEN a.inode_id = 0 THEN 255 ELSE 127 END) AS rights FROM reach r JOIN gr a ON a.inode_id = r.node GROUP BY ALL)"""


@query("effective_rights", "SELECT inode_id, principal, rights FROM eff", MID + ", " + _RIGHTS)
def _(g):
    return g.view().effective_rights()


@query("admins", "SELECT principal FROM gr WHERE inode_id = 0 AND rights & 128 <> 0", MID + ", " + _RIGHTS)
def _(g):
    return g.view().access().where("inode_id = 0").select(F.explode("grants").alias("principal", "rights")).where(F.col("rights").bitwiseAND(128) != 0).select("principal")


@query("listing_masked_by_rights", "SELECT p.inode_id, p.path, e.inode_id IS NOT NULL AS readable, CASE WHEN e.inode_id IS NOT NULL THEN r.content_id END AS content_id FROM paths p LEFT JOIN rev r USING (inode_id) LEFT JOIN eff e ON e.inode_id = p.inode_id AND e.principal = 'p1' AND e.rights & 1 <> 0 WHERE p.inode_kind = 'file'", MID + ", " + _REV + ", " + _RIGHTS)
def _(g):
    v = g.view()
    return reads.masked(v.entries().where("inode_kind = 'file'").select("inode_id", "path", "content_id"), v.effective_rights(), "p1").select("inode_id", "path", "readable", "content_id")


_SIZES = "SELECT doc_id AS content_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size_bytes, coalesce(text, '') AS body FROM documents"


#: Layout rows: the extents that the lines of an order write of a part.
_LAYOUTS = "SELECT l_partkey AS content_id, CAST(floor(l_extendedprice) AS BIGINT) AS size_bytes, max(l_orderkey) AS seq FROM lineitem GROUP BY ALL"


def layouts(g) -> DataFrame:
    return fixture.table(g.spark, g.dir, "lineitem").groupBy(F.col("l_partkey").alias("content_id"), F.floor("l_extendedprice").cast("bigint").alias("size_bytes")).agg(F.max("l_orderkey").alias("seq"))


@query("content_head", "SELECT inode_id, max(size_bytes) AS size_bytes, arg_max(revision_no, size_bytes * 1000000000 + seq) AS revision_no FROM revisions GROUP BY inode_id")
def _(g):
    return retention.content_heads(families.revisions(g.deltas())).select("inode_id", "size_bytes", "revision_no")


@query("content_layout_longest", f"SELECT content_id, size_bytes, seq FROM ({_LAYOUTS}) QUALIFY row_number() OVER (PARTITION BY content_id ORDER BY size_bytes DESC, seq DESC) = 1", None)
def _(g):
    return retention.keep_layouts(layouts(g))


# ---- changes

_KINDS = """CASE kinds WHEN 'create_inode,bind_direntry' THEN 'directory_created' WHEN 'create_inode,bind_direntry,append_file_revision' THEN 'file_created' WHEN 'append_file_revision' THEN 'content_changed'
 WHEN 'unbind_direntry,bind_direntry' THEN 'moved' WHEN 'unbind_direntry,tombstone_subtree' THEN 'deleted' WHEN 'revoke_subtree_tombstone,bind_direntry' THEN 'restored'
 WHEN 'append_attributes_revision' THEN 'attributes_changed' WHEN 'append_access_revision' THEN 'access_changed' ELSE 'corrupt' END"""
_EVENTS = f"feed AS (SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY op_index) - 1 AS event_index, {_KINDS} AS event_kind, inode_id, parent_id, revision_no, display_name FROM (SELECT seq, op_index, string_agg(kind, ',' ORDER BY delta_index) AS kinds, arg_min(inode_id, delta_index) AS inode_id, max(parent_id) FILTER (kind = 'bind_direntry') AS parent_id, max(display_name) FILTER (kind = 'bind_direntry') AS display_name, max(revision_no) AS revision_no FROM deltas GROUP BY seq, op_index))"


@query("events_all", "SELECT * FROM feed WHERE seq > 0", _EVENTS)
def _(g):
    return changes.events(g.deltas()).select("seq", "event_index", "event_kind", "inode_id", "parent_id", "revision_no", "display_name")


@query("events_by_kind", "SELECT event_kind, count(*) AS n FROM feed GROUP BY ALL", _EVENTS)
def _(g):
    return changes.events(g.deltas(), -1).groupBy("event_kind").agg(F.count("*").alias("n"))


@query("changes_page", "SELECT seq, event_index, event_kind, inode_id FROM feed WHERE seq IN (SELECT DISTINCT seq FROM feed, marks WHERE seq > mid ORDER BY seq LIMIT 100)", _EVENTS)
def _(g):
    return changes.feed(g.deltas(), g.m["mid"], 100).select("seq", "event_index", "event_kind", "inode_id")


@query("changes_split", "SELECT seq, event_index, event_kind FROM (SELECT *, sum(64 + length(event_kind) + coalesce(strlen(display_name), 0)) OVER (ORDER BY seq, event_index) AS total FROM feed, marks WHERE seq >= s1) WHERE total <= 9000", _EVENTS)
def _(g):
    return changes.feed_within(g.deltas(), g.m["s1"] - 1, 9000, changes.event_size()).select("seq", "event_index", "event_kind")


@query("changes_page_budget", "SELECT seq, event_index, event_kind FROM feed WHERE seq IN (SELECT seq FROM (SELECT seq, sum(sum(64 + length(event_kind) + coalesce(strlen(display_name), 0))) OVER (ORDER BY seq) AS total, row_number() OVER (ORDER BY seq) AS n FROM feed, marks WHERE seq > mid GROUP BY seq) WHERE n <= 100 AND (total <= 5000 OR n = 1))", _EVENTS)
def _(g):
    return changes.feed(g.deltas(), g.m["mid"], 100, 5000, g.m["floor"]).select("seq", "event_index", "event_kind")


@query("append_offsets", "SELECT inode_id, revision_no, size_bytes, coalesce(lag(size_bytes) OVER (PARTITION BY inode_id ORDER BY revision_no), 0) AS append_offset FROM revisions")
def _(g):
    return changes.append_offsets(g.deltas()).select("inode_id", "revision_no", "size_bytes", "append_offset")


def _state(tag: str, at: str) -> str:
    new = lambda kind, cols: f"(SELECT inode_id, {cols} FROM deltas, marks WHERE kind = '{kind}' AND seq <= {at} {PICK.format('inode_id')})"
    return f"""st{tag} AS (SELECT i.inode_id, i.inode_kind, p.path, p.parent_id, p.display_name, r.revision_no, a.attributes_revision_no, x.access_revision_no FROM inodes i CROSS JOIN marks LEFT JOIN paths{tag} p USING (inode_id)
 LEFT JOIN {new('append_file_revision', 'revision_no')} r USING (inode_id) LEFT JOIN {new('append_attributes_revision', 'attributes_revision_no')} a USING (inode_id) LEFT JOIN {new('append_access_revision', 'access_revision_no')} x USING (inode_id) WHERE i.seq <= {at})"""


_DIFF = f"""{MID}, {LATE}, {_state('', 'mid')}, {_state('_b', 'late')},
 touch AS (SELECT inode_id, max(seq) AS last_touch_seq FROM deltas, marks WHERE seq > mid AND seq <= late GROUP BY inode_id),
 d AS (SELECT t.inode_id, t.last_touch_seq, coalesce(b.inode_kind, a.inode_kind) AS inode_kind, b.path, a.path AS old_path, a.revision_no AS ar, b.revision_no AS br, a.attributes_revision_no AS aa, b.attributes_revision_no AS ba, a.access_revision_no AS ax, b.access_revision_no AS bx,
  CASE WHEN a.path IS NULL AND b.path IS NOT NULL THEN CASE WHEN a.inode_id IS NULL THEN 'created' ELSE 'restored' END WHEN a.path IS NOT NULL AND b.path IS NULL THEN 'deleted'
   WHEN a.path IS NOT NULL AND (a.parent_id, a.display_name) <> (b.parent_id, b.display_name) THEN 'moved'
   WHEN a.path IS NOT NULL AND (a.revision_no IS DISTINCT FROM b.revision_no OR a.attributes_revision_no IS DISTINCT FROM b.attributes_revision_no OR a.access_revision_no IS DISTINCT FROM b.access_revision_no) THEN 'changed' END AS kind
  FROM touch t LEFT JOIN st a ON a.inode_id = t.inode_id LEFT JOIN st_b b ON b.inode_id = t.inode_id),
 difference AS (SELECT inode_id, kind, inode_kind, path, CASE WHEN kind IN ('moved', 'deleted') THEN old_path END AS previous_path,
  CASE WHEN kind IN ('created', 'restored') THEN br WHEN kind IN ('moved', 'changed') AND ar IS DISTINCT FROM br THEN br END AS revision_no,
  CASE WHEN kind IN ('moved', 'changed') AND aa IS DISTINCT FROM ba THEN ba END AS attributes_revision_no, CASE WHEN kind IN ('moved', 'changed') AND ax IS DISTINCT FROM bx THEN bx END AS access_revision_no, last_touch_seq, old_path FROM d WHERE kind IS NOT NULL)"""


@query("diff_root", "SELECT * EXCLUDE (old_path) FROM difference", _DIFF)
def _(g):
    return changes.diff(g.deltas(), g.m["mid"], g.m["late"], max_depth=DEPTH)


@query("diff_scoped", f"SELECT * EXCLUDE (old_path) FROM difference WHERE path = {_LISTED} OR starts_with(path, {_LISTED} || '/') OR old_path = {_LISTED} OR starts_with(old_path, {_LISTED} || '/') OR (inode_kind = 'directory' AND kind IN ('deleted', 'moved', 'restored') AND (starts_with({_LISTED}, path || '/') OR starts_with({_LISTED}, old_path || '/')))", _DIFF)
def _(g):
    return changes.diff(g.deltas(), g.m["mid"], g.m["late"], [x.lower() for x in _listed(g).split("/")[1:]], DEPTH)


@query("touched_inodes", "SELECT DISTINCT inode_id FROM deltas, marks WHERE seq > mid AND seq <= late")
def _(g):
    return changes.touched(g.deltas(), g.m["mid"], g.m["late"]).select("inode_id")


@query("last_touch", "SELECT inode_id, max(seq) AS last_touch_seq FROM deltas, marks WHERE seq > mid AND seq <= late GROUP BY inode_id")
def _(g):
    return changes.touched(g.deltas(), g.m["mid"], g.m["late"])


@query("activity_counters", "SELECT CAST(sum(size_bytes) AS BIGINT) AS content_bytes, count(*) AS file_revisions, (SELECT count(*) FROM (SELECT DISTINCT seq, op_index FROM deltas, marks WHERE seq > floor_seq)) AS mutations FROM revisions, marks WHERE seq > floor_seq")
def _(g):
    return stats.activity(g.deltas(), g.m["floor"])


_FOOT = {"inodes": ("inodes", "inode_id"), "bindings": ("binds", "child_id"), "revisions": ("revisions", "inode_id"), "tombstones": ("tombs", "root_id"), "trash": ("tombs", "root_id"), "attributes": ("(SELECT * FROM deltas WHERE kind = 'append_attributes_revision')", "inode_id"), "access": ("(SELECT * FROM deltas WHERE kind = 'append_access_revision')", "inode_id")}


@query("footprint", " UNION ALL ".join(f"SELECT '{f}' AS family, count(*) AS rows, count(DISTINCT {k}) AS inodes FROM {t}" for f, (t, k) in _FOOT.items()))
def _(g):
    return stats.footprint(g.deltas())


@query("binding_index_parity", "SELECT true AS equal, count(*) AS rows FROM binds")
def _(g):
    b = families.bindings(g.deltas())
    cols = ("parent_id", "name_key", "child_id", "seq", "delta_index", "bound")
    one, two = stats.digest(b, *cols), stats.digest(b.repartition(4, "child_id").sortWithinPartitions("child_id", "seq"), *cols)
    return one.crossJoin(two.select(F.col("digest").alias("other"))).select((F.col("digest") == F.col("other")).alias("equal"), "rows")
