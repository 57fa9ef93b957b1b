"""The engine on literal ledgers, against plain Python."""

import pytest
from pyspark.sql import functions as F

from treeledger import schema as S
from treeledger.functions import names
from treeledger.operators import asof, changes, families, grep, namespaces, postings, reads, retention, tree
from treeledger.plans import commit, compaction, grams, merging, ordering
from treeledger.sources import log, shared
from treeledger.streaming import feed


@pytest.fixture(scope="module")
def ledger(spark):
    """A small history planned by commits; head 7."""
    t, rows = commit.Tree(0), []
    rows.append(dict.fromkeys(S.DELTA_COLUMNS) | {"seq": 0, "op_index": 0, "delta_index": 0, "kind": S.CREATE, "inode_id": 0, "inode_kind": "directory", "committed_by": "s", "committed_at_ms": 0})
    for ops in (
        [{"kind": "put_file", "path": "/a/b/f.txt", "content_id": 1}, {"kind": "create_directory", "path": "/c"}],
        [{"kind": "put_file", "path": "/a/b/f.txt", "content_id": 2, "replace": True}],
        [{"kind": "move", "path": "/a/b/f.txt", "to": "/c/G.txt"}],
        [{"kind": "put_file", "path": "/a/h.txt", "content_id": 3}, {"kind": "update_attributes", "path": "/a/h.txt", "set": {"k": "1"}}],
        [{"kind": "delete", "path": "/a", "recursive": True}],
        [{"kind": "move", "path": "/c/G.txt", "to": "/c/g.txt"}],
        [{"kind": "restore_deleted", "inode_id": 1, "deletion_seq": 5}],
    ):
        rows += commit.plan(t, ops, committed_by="w", committed_at_ms=t.head)
    return spark.createDataFrame([tuple(r[c] for c in S.DELTA_COLUMNS) for r in rows], S.DELTAS).cache()


def visible(ledger, at):
    return sorted(r["path"] for r in tree.paths(ledger, at).collect())


def test_paths_over_time(ledger):
    assert visible(ledger, 1) == ["/", "/a", "/a/b", "/a/b/f.txt", "/c"]
    assert visible(ledger, 3) == ["/", "/a", "/a/b", "/c", "/c/G.txt"]
    assert visible(ledger, 5) == ["/", "/c", "/c/G.txt"]
    assert visible(ledger, 6) == ["/", "/c", "/c/g.txt"]  # case-only rename keeps the slot
    assert visible(ledger, 7) == ["/", "/a", "/a/b", "/a/h.txt", "/c", "/c/g.txt"]


def test_walk_lists_a_directory_before_its_content(ledger):
    assert [r["path"] for r in reads.View(ledger, 7, 8).walk().collect()] == ["/", "/a", "/a/b", "/a/h.txt", "/c", "/c/g.txt"]


def test_read_by_id_depends_on_the_floor(ledger):
    allowed = lambda floor: {r["inode_id"] for r in tree.readable(ledger, 5, floor, 8).where("allowed").collect()}
    assert 1 in allowed(4) and 1 not in allowed(5)


def test_events_name_each_operation(ledger):
    got = [(r["seq"], r["event_kind"]) for r in changes.events(ledger).orderBy("seq", "event_index").collect()]
    assert (3, "moved") in got and (5, "deleted") in got and (7, "restored") in got and (4, "attributes_changed") in got
    assert (1, "directory_created") in got and (1, "file_created") in got
    assert [k for _, k in got].count("corrupt") == 0  # parents made on the way are events of their own


def test_diff_kinds(ledger):
    got = {r["inode_id"]: (r["kind"], r["path"], r["previous_path"]) for r in changes.diff(ledger, 2, 6, max_depth=8).collect()}
    assert got[1] == ("deleted", None, "/a") and got[3] == ("moved", "/c/g.txt", "/a/b/f.txt")
    assert 2 not in got  # below a deleted directory, not touched itself


def test_compaction_keeps_reads_at_and_above_the_floor(ledger):
    kept = retention.as_deltas(retention.compact(ledger, 4))
    for at in (4, 5, 6, 7):
        assert visible(kept, at) == visible(ledger, at)


def test_whole_state_keeps_the_newest_at_the_floor(ledger):
    r = retention.keep_whole_state(families.revisions(ledger), "revision_no", 3)
    assert sorted((x["inode_id"], x["revision_no"]) for x in r.collect()) == [(3, 2), (5, 1)]


def test_asof_join_takes_the_newest_not_later(spark):
    rows = spark.createDataFrame([(1, 5, 0, "a"), (1, 9, 0, "b"), (2, 1, 0, "c")], "k long, seq long, delta_index long, v string")
    points = spark.createDataFrame([(1, 4), (1, 5), (1, 8), (1, 20), (3, 9)], "k long, at long")
    got = {(r["k"], r["at"]): r["row_v"] for r in asof.asof_join(points, rows, ["k"], "at").collect()}
    assert got == {(1, 4): None, (1, 5): "a", (1, 8): "a", (1, 20): "b", (3, 9): None}


def test_cycles_and_deep_chains(spark):
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, 128)] + [(200, 201), (201, 202), (202, 200)], "child_id long, parent_id long")
    assert sorted(r[0] for r in tree.cycles(edges).collect()) == [200, 201, 202]
    deep = {r["child_id"]: r["n"] for r in tree.chains(edges.where("child_id < 200")).select("child_id", F.size("chain").alias("n")).collect()}
    assert deep == {i: i for i in range(1, 128)}


@pytest.mark.parametrize("operation, code", [
    ({"kind": "move", "path": "/a", "to": "/a/b/x"}, "would_create_cycle"),
    ({"kind": "delete", "path": "/a"}, "directory_not_empty"),
    ({"kind": "put_file", "path": "/A/H.txt", "content_id": 1}, "already_exists"),
    ({"kind": "restore_deleted", "inode_id": 1, "deletion_seq": 9}, "not_in_trash"),
    ({"kind": "restore_revision", "path": "/a/h.txt", "revision_no": 4}, "revision_not_found"),
])
def test_refused_operations_change_nothing(ledger, operation, code):
    t = commit.Tree.load(ledger, 7)
    with pytest.raises(commit.Refused) as e:
        commit.plan(t, [{"kind": "put_file", "path": "/z", "content_id": 1}, operation])
    assert e.value.code == code and e.value.index == 1 and t.head == 7 and t.resolve("/z") is None


def test_a_part_of_a_namespace_is_planned_on(ledger):
    spark = ledger.sparkSession
    ops = [{"kind": "update_attributes", "inode_id": 5, "set": {"new": "1"}}, {"kind": "append_file", "inode_id": 3, "content_id": 9}]
    part = commit.Tree.load(ledger, 7, most=5, of=spark.createDataFrame([(5,), (3,)], "inode_id long"))  # 6 inodes in all
    whole = commit.Tree.load(ledger, 7)
    assert commit.plan(part, ops) == commit.plan(whole, ops) and part.next_inode() == whole.next_inode()
    with pytest.raises(commit.Refused):
        commit.plan(part, [{"kind": "delete", "inode_id": 1}])  # not empty
    for name in ("/c/none", "/b"):
        with pytest.raises(ValueError, match="not loaded"):
            part.resolve(name)
    deleted = commit.Tree.load(ledger, 5, of=spark.createDataFrame([(1,)], "inode_id long"))
    assert [r["kind"] for r in commit.plan(deleted, [{"kind": "restore_deleted", "inode_id": 1, "deletion_seq": 5}])] == [S.REVOKE, S.BIND]


def test_preconditions_together_are_those_one_by_one(ledger):
    asked = [{"kind": "namespace_head", "seq": s} for s in (6, 7)]
    asked += [{"kind": k, "inode_id": i, "revision_no": n} for k in ("file_revision", "attributes_revision", "access_revision") for i in (3, 5, 99) for n in (0, 1, 2)]
    asked += [{"kind": "path_absence", "path": p} for p in ("/", "/A/H.txt", "/a/none", "/c/g.txt", "/c/g.txt")]
    asked += [{"kind": "name_absence", "parent_id": p, "name": n} for p, n in ((0, "A"), (0, "b"), (4, "G.TXT"), (1, "f.txt"))]
    asked += [{"kind": k, **of, "bound_at": at} for at in ((6, 1), (7, 1), (1, 1)) for k, of in (("path_binding", {"path": "/c/G.TXT"}), ("inode_binding", {"inode_id": 1}), ("inode_binding", {"inode_id": 3}))]
    t = commit.Tree.load(ledger, 7)

    def holds(p):
        try:
            commit.check(t, [p])
        except commit.Refused:
            return False
        return True

    columns = ["no", "kind", "path", "inode_id", "revision_no", "seq", "bound_at", "parent_id", "name"]
    rows = [tuple(({"no": i} | p).get(c) for c in columns) for i, p in enumerate(asked)]
    df = ledger.sparkSession.createDataFrame(rows, "no int, kind string, path string, inode_id long, revision_no long, seq long, bound_at struct<seq:long,delta_index:long>, parent_id long, name string")
    got = {r["no"]: r["holds"] for r in commit.holding(ledger, 7, df).collect()}
    assert got == {i: holds(p) for i, p in enumerate(asked)} and {True, False} <= set(got.values())


def test_gram_plans():
    hexes = lambda p, i=False: None if (s := grams.plan(p, i)) is None else [sorted(x) for x in s]
    assert hexes("needle") == [[b"nee"], [b"eed"], [b"edl"], [b"dle"]]
    assert hexes("^(ab)(cd)$") == [[b"abc"], [b"bcd"]]
    both = hexes("needle|haystack")
    assert both and all(any(g in b"needle" for g in s) and any(g in b"haystack" for g in s) for s in both)
    assert hexes("[ab]cd") == [[b"acd", b"bcd"]] and hexes("x(foo|bar)y")[0] == [b"xba", b"xfo"]
    assert hexes("foo.+bar") == [[b"foo"], [b"bar"]]
    assert hexes("straße", True) == [[b"tra"]]
    assert all(hexes(p) is None for p in ("(needle)?", ".*", "ab", "needle|n."))
    with pytest.raises(ValueError):
        grams.check(r"(a)\1")


def test_grep_gives_one_row_a_line(spark):
    c = spark.createDataFrame([(1, "one needle needle\nünö needle\nno"), (2, "nothing"), (3, "a\0needle")], "content_id long, body string")
    for index in (None, grep.postings(c)):
        got = sorted((r["content_id"], r["line_no"], r["byte_offset"]) for r in grep.grep(c, index, "needle").collect())
        assert got == [(1, 1, 4), (1, 2, 24)]


def test_lines_end_at_line_feeds_alone_and_cuts_are_lossy(spark):
    texts = ["needle\r\nneedle", "a\u2028needle b", "é" * 300 + " needle", "one\ntwo\nthree one\ntwo", "x" * 600 + "needle needle", "NEEDLE"]
    c = spark.createDataFrame(list(enumerate(texts)), "content_id long, body string")
    found = lambda p, i=False: sorted((r["content_id"], r["line_no"], r["byte_offset"], r["line_truncated"]) for r in grep.grep(c, grep.postings(c), p, i).collect())
    assert found("needle$") == [(0, 2, 8, False), (2, 1, 601, True), (4, 1, 607, True)]
    assert found("^.*needle b$") == [(1, 1, 0, False)]
    assert found("one\\ntwo") == [(3, 1, 0, False), (3, 3, 14, False)]
    assert {r[0] for r in found("needle", True)} == {0, 1, 2, 4, 5}
    cut = grep.grep(c, None, " needle$").where("content_id = 2").first()
    assert cut["line"] == "é" * 256 and len(grep.grep(c, None, "x needle").collect()) == 0
    half = grep.line_matches(spark.createDataFrame([(1, "a" + "é" * 300)], "content_id long, body string"), "é").first()
    assert half["line"] == "a" + "é" * 255 + "\ufffd" and half["line_truncated"]
    with pytest.raises(ValueError):
        grep.line_matches(c, r"(?=a)b")


def test_eligible_text(spark):
    rows = [(1, b"plain"), (2, b"a\x00b"), (3, b"\xff\xfe"), (4, b"a" * 8191 + "é".encode()), (5, b"a" * 8192 + b"\xff\x00"), (6, b"a" * 8191 + b"\xff"), (7, b""), (8, b"a" * 8190 + "😀".encode())]
    c = spark.createDataFrame(rows, "content_id long, body binary")
    assert {r["content_id"] for r in grep.eligible(c).where("eligible").collect()} == {1, 4, 5, 7, 8}


def test_compaction_windows():
    assert compaction.window([10, 9, 8], 3) is None
    assert compaction.window([10, 9, 8, 7], 3) == range(0, 4)
    assert compaction.window([1000, 10, 9, 8, 7], 4) == range(1, 5)
    assert compaction.window([1] * 12, 5) == range(0, 8)
    assert compaction.window([10**9, 10**7, 10**5, 10**3, 10], 8) == range(3, 5)
    # the examples of the policy
    assert compaction.window([300, 90, 100, 110, 2], 4, False) == range(0, 4)
    assert compaction.window([400, 40, 2, 1, 1], 8, False) == range(2, 5) and compaction.window([400, 40, 30, 1], 8, False) == range(1, 4)
    assert compaction.window([100], 8) == range(0, 1) and compaction.window([100], 8, False) is None and compaction.window([], 9) is None
    assert compaction.placement(range(0, 3), [1, 5, 9, 12], 20) == ("base", True, 20)
    assert compaction.placement(range(1, 3), [1, 5, 9, 12], 20) == ("delta", False, 9)


def test_ordering_breaks_a_swap():
    got = ordering.ordered({1: {"action": "move", "parent": 0, "name": "b"}, 2: {"action": "move", "parent": 0, "name": "a"}}, {(0, "a"): 1, (0, "b"): 2})
    assert [(c["inode_id"], c["action"]) for c in got] == [(1, "park"), (2, "move"), (1, "move")]


def test_ordering_leaves_a_directory_before_its_deletion():
    changes = {1: {"action": "delete"}, 2: {"action": "move", "parent": 3, "name": "x"}, 3: {"action": "create", "parent": 4, "name": "n"}, 4: {"action": "create", "parent": 0, "name": "m"}}
    got = [c["inode_id"] for c in ordering.ordered(changes, {(0, "d"): 1, (1, "x"): 2})]
    assert got == [4, 3, 2, 1]
    with pytest.raises(ValueError):
        ordering.ordered({1: {"action": "create", "parent": 2, "name": "a"}, 2: {"action": "create", "parent": 1, "name": "b"}}, {})


@pytest.mark.parametrize("rounds", [0, 1, 8])
def test_merge_operations_of_any_number_can_be_applied_in_order(spark, monkeypatch, rounds):
    monkeypatch.setattr(merging, "ROUNDS", rounds, raising=False)
    bind = lambda i, p, n: dict.fromkeys(S.DELTA_COLUMNS) | {"seq": 1, "op_index": i, "delta_index": i, "kind": S.BIND, "inode_id": i, "inode_kind": "file", "parent_id": p, "name_key": n, "display_name": n.upper()}
    held = {i: (0, f"n{i}") for i in range(1, 41)} | {50: (0, "d"), 51: (50, "x"), 52: (50, "y"), 70: (0, "other"), 71: (0, "swap")}
    target = spark.createDataFrame([tuple(bind(i, *at)[c] for c in S.DELTA_COLUMNS) for i, at in held.items()], S.DELTAS)
    moves = {i: ("move", 0, f"n{i % 20 + 1}") for i in range(1, 21)}  # a ring
    moves |= {i: ("move", 0, f"n{i + 1}") for i in range(21, 41)}  # a chain to a free name
    moves |= {50: ("delete", None, None), 51: ("move", 60, "in"), 52: ("move_update", 61, "deep"), 60: ("create", 0, "e"), 61: ("create", 60, "sub"), 62: ("create", 0, "d"), 70: ("update", 0, "other"), 71: ("restore", 61, "z")}
    rows = [(i, a, None, p, n, n and n.upper()) for i, (a, p, n) in moves.items()] + [(99, "move", "name", 0, "q", "Q")]
    plan = spark.createDataFrame(rows, "inode_id long, action string, conflict string, ours_edge_parent long, ours_edge_key string, ours_edge_name string")
    done = merging.execution(plan, target, 1).orderBy("position").collect()
    assert [r["position"] for r in done] == list(range(len(done)))
    told = sorted((r["inode_id"], r["action"]) for r in done if r["action"] != "park")
    assert told == sorted((i, a) for i, (x, _, _) in moves.items() for a in x.split("_")) and sum(r["action"] == "park" for r in done) == 1
    where, now, made = dict(held), {at: i for i, at in held.items()}, {0}
    del where[71], now[0, "swap"]
    for r in done:
        i, a = r["inode_id"], r["action"]
        if a == "update":
            continue
        assert a != "delete" or not any(p == i for p, _ in where.values())
        if i in where:
            del now[where.pop(i)]
        if a != "delete":
            at = (r["parent_id"], r["name"].lower())
            assert at not in now and r["parent_id"] in made
            now[at], where[i] = i, at
            made |= {i} if a == "create" else set()
    assert {i: at for i, at in where.items() if i != 70} == {i: (p, n) for i, (a, p, n) in moves.items() if p is not None and a != "update"}


def test_reads_go_by_name_key(ledger):
    v = reads.View(ledger, 7)
    assert v.locate("/C/g.TXT") == (3, "/c/g.txt") and v.locate("/") == (0, "/") and v.locate("/a/nothing") is None
    assert [r["path"] for r in v.listdir("/A").collect()] == ["/a/b", "/a/h.txt"]
    assert [r["path"] for r in v.listdir("/", after="a", limit=1).collect()] == ["/c"] and v.listdir("/none").count() == 0
    asked = ledger.sparkSession.createDataFrame([("/A/H.TXT",), ("/a/none",), ("/",), ("/c",)], "path string")
    got = {r["path"]: r for r in v.stat(asked).collect()}
    assert got["/A/H.TXT"]["found_path"] == "/a/h.txt" and got["/A/H.TXT"]["attributes"] == {"k": "1"} and not got["/a/none"]["found"] and got["/"]["inode_id"] == 0
    assert reads.View(ledger, 5).locate("/a") is None  # deleted
    assert [r["revision_no"] for r in v.revisions(3).collect()] == [2, 1] and [r["revision_no"] for r in v.revisions(3, floor=2).collect()] == [2]
    ids = ledger.sparkSession.createDataFrame([(3,), (2,), (99,)], "inode_id long")
    assert {r["inode_id"]: (r["path"], r["missing"]) for r in v.stat_inodes(ids).collect()} == {3: ("/c/g.txt", None), 2: ("/a/b", None), 99: (None, "never_created")}
    with pytest.raises(reads.BelowRetentionFloor):
        reads.View(ledger, 3, floor=4)


def test_paths_of_some_inodes_are_those_of_the_whole_tree(ledger):
    for at in (1, 3, 5, 7):
        whole = {r["inode_id"]: r["path"] for r in tree.paths(ledger, at).collect()}
        some = ledger.sparkSession.createDataFrame([(0,), (2,), (3,), (5,)], "inode_id long")
        assert {r["inode_id"]: r["path"] for r in tree.paths(ledger, at, of=some).collect()} == {i: p for i, p in whole.items() if i in (0, 2, 3, 5)}


def test_too_deep_trees_are_refused(spark):
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, 9)], "child_id long, parent_id long")
    assert tree.chains(edges, 8).count() == 8
    with pytest.raises(tree.TooDeep):
        tree.chains(edges, 4)


def test_chains_below_one_node_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(tree, "SHARE", 100, raising=False)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    edges = spark.createDataFrame([(1, 0), (2, 1), (3, 2), *((i, 3) for i in range(10, 810))], "child_id long, parent_id long")
    got = tree.chains(edges)
    for c in ("adaptive.coalescePartitions.enabled", "autoBroadcastJoinThreshold"):
        spark.conf.unset(f"spark.sql.{c}")
    assert {r["n"] for r in got.where("child_id >= 10").select(F.size("chain").alias("n")).collect()} == {4} and got.count() == 803
    files = got.where("child_id >= 10").groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in files) < 500  # all wait for node 3, then for node 1, then for the root


@pytest.fixture
def spread(spark):
    """Shuffles as on large tables: nothing is broadcast or coalesced."""
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k in conf:
        spark.conf.unset(k)


def test_one_large_commit_is_stored_by_several_tasks(spread):
    rows = spread.range(1000).selectExpr("'create_inode' kind", "cast(0 as bigint) seq", "id delta_index")
    got = shared.stored(rows, "log", ["kind"])
    assert got.count() == 1000 and max(r["count"] for r in got.groupBy(F.input_file_name()).count().collect()) < 1000


def test_a_commit_of_any_size_is_appended_unsorted(ledger, tmp_path, monkeypatch):
    monkeypatch.delattr(type(ledger), "sortWithinPartitions")  # would hold the commit in one task's memory
    log.append(ledger, f"{tmp_path}/log")
    files = log.read(ledger.sparkSession, f"{tmp_path}/log").withColumn("file", F.input_file_name()).groupBy("seq").agg(F.count_distinct("file").alias("n"))
    assert files.where("n > 1").count() == 0 and files.count() == 8


def test_rows_of_one_namespace_are_dealt_out(spread):
    n = spread.createDataFrame([("main", "p", "active", None, None, 0, 9), ("fork", "p", "active", "main", 500, 500, 900)], namespaces.NAMESPACES)
    rows = spread.range(1000).selectExpr("'main' namespace_id", "id seq", "cast(0 as bigint) delta_index")
    got = namespaces.lineage(n, rows)
    assert {r["reader"]: r["count"] for r in got.groupBy("reader").count().collect()} == {"main": 1000, "fork": 501}
    parts = got.where("reader = 'main'").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in parts) < 1000


def test_layouts_by_a_given_order(spark):
    rows = spark.createDataFrame([(1, 10, 1), (1, 9, 3_000_000), (2, 5, 7)], "content_id long, size_bytes long, seq long").withColumn("best", F.expr("size_bytes * 1000000 + seq"))
    assert {tuple(r)[:3] for r in retention.keep_layouts(rows).collect()} == {(1, 10, 1), (2, 5, 7)}
    assert {tuple(r)[:3] for r in retention.keep_layouts(rows, "best").collect()} == {(1, 9, 3_000_000), (2, 5, 7)}


def test_rights_of_many_principals(ledger):
    t = commit.Tree.load(ledger, 7)
    rows = commit.plan(t, [{"kind": "update_access", "path": "/a", "grants": {"x": 3, "y": 4}}, {"kind": "update_access", "path": "/a/b", "grants": {"x": 8}, "boundary": True}])
    more = ledger.unionByName(ledger.sparkSession.createDataFrame([tuple(r[c] for c in S.DELTA_COLUMNS) for r in rows], S.DELTAS))
    got = {(r["inode_id"], r["principal"]): r["rights"] for r in reads.View(more, 8).effective_rights().collect()}
    assert got == {(1, "x"): 3, (1, "y"): 4, (2, "x"): 8, (5, "x"): 3, (5, "y"): 4}


def test_expired_subtrees_go_in_a_compaction(ledger):
    deleted = retention.compact(ledger, 6, head=6)
    assert {r["inode_id"] for r in deleted["inodes"].collect()} == {0, 3, 4}
    kept = retention.compact(ledger, 4, head=6)
    assert {r["inode_id"] for r in kept["inodes"].collect()} == {0, 1, 2, 3, 4, 5}
    assert retention.compact(ledger, 6, drops_rows=False)["bindings"].count() == families.bindings(ledger).count()


def test_postings_code():
    assert postings.coded([7, 8, 300]).hex() == "030701a402" and postings.decoded(bytes.fromhex("030701a402")) == [7, 8, 300]
    for bad in (b"", b"\x00", b"\x02\x07", b"\x02\x07\x00", b"\x01\x07\x01", b"\x01\x87"):
        with pytest.raises(ValueError):
            postings.decoded(bad)
    with pytest.raises(ValueError):
        postings.coded([3, 3])


def test_postings_are_coded_as_they_stream(spark):
    values = spark.range(3000).select(F.col("id").alias("content_id"), F.lit(1).cast("long").alias("size_bytes"), (F.col("id") * 50).alias("ordinal"))
    grams = spark.range(3000).select(F.explode(F.array(F.lit("61"), F.lit("62"), F.lit("62"), F.when(F.col("id") == 7, "63"))).alias("gram"), F.col("id").alias("content_id")).where("gram is not null")
    run = postings.coded_run(grams, values)
    assert "ollect" not in run._jdf.queryExecution().executedPlan().toString()  # no list is made of a row's numbers
    got = {(r["gram"], r["first_ordinal"]): bytes(r["postings"]) for r in run.collect()}
    want = {}
    for gram, ids in (("61", range(3000)), ("62", range(3000)), ("63", [7])):
        for stretch in range(3):
            if numbers := [50 * i for i in ids if 50 * i // postings.STRETCH == stretch]:
                want[gram, numbers[0]] = postings.coded(numbers)
    assert got == want
    assert sorted(map(tuple, postings.read_run(run, values).collect())) == sorted({tuple(r) for r in grams.collect()})
    with pytest.raises(Exception, match="not postings"):
        postings.read_run(spark.createDataFrame([("61", b"\x02\x07")], "gram string, postings binary"), values).collect()


def test_namespaces(spark):
    n = spark.createDataFrame([], namespaces.NAMESPACES)
    n = namespaces.create(n, "a", "p").withColumn("head_seq", F.lit(9).cast("long"))
    n = namespaces.fork(n, "a", "b", 4)
    n = namespaces.rebased(n, "b", "c", 3)
    assert {(r["namespace_id"], r["fork_point_seq"], r["head_seq"]) for r in namespaces.page(n).collect()} == {("a", None, 9), ("b", 4, 4), ("c", 9, 12)}
    n = namespaces.delete(n, "a")
    assert [r["namespace_id"] for r in namespaces.page(n).collect()] == ["b", "c"] and namespaces.retired(n).count() == 0
    for wrong in (lambda: namespaces.create(n, "a", "p"), lambda: namespaces.fork(n, "a", "d"), lambda: namespaces.fork(n, "b", "d", 99), lambda: namespaces.delete(n, "zz")):
        with pytest.raises(ValueError):
            wrong()


def test_checksums_and_tokens(spark):
    data = bytes(range(256)) * 100
    for cut in (0, 1, 5000, len(data)):
        assert names.crc_joined(names.crc64nvme(data[:cut]), names.crc64nvme(data[cut:]), len(data) - cut) == names.crc64nvme(data)
    rows = spark.createDataFrame([("n:s", 5, 7)], "ns string, seq long, at long").select(names.binding_version(F.col("ns"), F.col("seq"), F.col("at")).alias("t"))
    assert tuple(rows.select(names.binding_position(F.col("t")).alias("p")).first()["p"]) == ("n:s", 5, 7)
    a, b = (spark.createDataFrame([(1, m)], "x long, m map<string,string>").select(names.fingerprint(F.col("x"), F.col("m")).alias("f")).first()[0] for m in ({"a": "1", "b": "2"}, {"b": "2", "a": "1"}))
    assert a == b


def test_one_writer_puts_an_object(spark, ledger, tmp_path):
    log.append(ledger.where("seq <= 3"), f"file://{tmp_path}/log", 1)
    with pytest.raises(log.Taken):
        log.append(ledger.where("seq > 3"), f"file://{tmp_path}/log", 1)
    files = log.read(spark, f"file://{tmp_path}/log").withColumn("file", F.input_file_name()).groupBy("seq").agg(F.count_distinct("file").alias("n"))
    assert files.where("n > 1").count() == 0 and files.count() == 4


def test_group_commit(spark, tmp_path):
    schema = "commit_id string, arrived_ms long, delta_index long, kind string, inode_id long"
    for k, rows in enumerate(([("a", 2, 0, S.CREATE, 1), ("b", 1, 0, S.CREATE, 2), ("b", 1, 1, S.BIND, 2)], [("a", 3, 0, S.CREATE, 1), ("c", 4, 0, S.CREATE, 3)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/requests")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/requests")
        feed.group_commits(spark, stream, f"{tmp_path}/log", f"{tmp_path}/receipts", f"{tmp_path}/cp", once=True).awaitTermination()
    assert {(r["commit_id"], r["seq"]) for r in spark.read.parquet(f"{tmp_path}/receipts").collect()} == {("b", 1), ("a", 2), ("c", 3)}
    got = log.read(spark, f"{tmp_path}/log").collect()
    assert sorted((r["seq"], r["delta_index"], r["inode_id"]) for r in got) == [(1, 0, 2), (1, 1, 2), (2, 0, 1), (3, 0, 3)]


def test_names(spark):
    assert names.fold_name("Straße") == "strasse" and names.fold_name("Ɤ") == "ɤ" and names.fold_name("é") == "é"
    rows = spark.createDataFrame([(x,) for x in ("a", "", ".", "..", "a/b", "con.txt", "x.", "x ", "   ", "a:b", "é" * 127, "é" * 128, None)], "n string")
    assert [r[0] for r in rows.select(names.valid_name(F.col("n"))).collect()] == [True] + [False] * 9 + [True, False, None]
    assert names.decode_inode(names.encode_inode(2**128 - 1)) == 2**128 - 1
    assert names.crc64nvme(b"123456789") == 0xAE8B14860A799888


def test_replay_stops_at_a_gap(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,), (5,), (6,)], "seq long")
    assert sorted(r[0] for r in retention.contiguous(rows, 0).collect()) == [1, 2, 3]
    assert sorted(r[0] for r in retention.contiguous(rows, 3).collect()) == []
    assert sorted(r[0] for r in retention.contiguous(rows, 4).collect()) == [5, 6]


def test_log_and_stream(spark, ledger, tmp_path):
    for lo, hi in ((-1, 3), (3, 7)):
        log.append(ledger.where((F.col("seq") > lo) & (F.col("seq") <= hi)), f"{tmp_path}/log")
    assert log.replay(spark, f"{tmp_path}/log").count() == ledger.count()
    feed.follow(spark, f"{tmp_path}/log", f"{tmp_path}/events", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/events").count() == changes.events(ledger).count()
    log.write_run({k: f(ledger) for k, f in families.FAMILIES.items()}, f"{tmp_path}/run")
    assert log.read_run(spark, f"{tmp_path}/run")["bindings"].count() == families.bindings(ledger).count()
