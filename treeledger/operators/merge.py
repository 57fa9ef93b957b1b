"""Three-way merges of a fork: ranges, net change, classification, replay.

``ours`` is the fork at its head, ``base`` the fork at the range's start, ``theirs`` the namespace merged into. A row of
theirs is the fork's own if it is at or before the fork point or came by an earlier merge of this fork.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..sources.shared import stored
from . import tree
from .changes import states, touched


def fork_view(source: DataFrame, own: DataFrame, fork_point: int) -> DataFrame:
    """A fork reads its source up to the fork point and its own rows after it; nothing is copied."""
    return source.where(F.col("seq") <= fork_point).unionByName(own.where(F.col("seq") > fork_point))


def range_start(merges: DataFrame, fork: str, fork_point: int) -> int:
    """A merge begins where the fork's latest one ended, or at the fork point. merges: source, seq, source_through_seq."""
    got = merges.where(F.col("source") == fork).agg(F.max_by("source_through_seq", "seq")).first()[0]
    return fork_point if got is None else got


def next_range(start: int, head: int, requested_through: int | None = None) -> tuple[str, int, int]:
    """Outcome, after, through: ``empty`` if nothing is new, ``partial`` if the request stops before the head, else ``full``."""
    through = head if requested_through is None else min(head, max(start, requested_through))
    return ("empty" if through == start else "partial" if through < head else "full", start, through)


def _side(df: DataFrame, p: str) -> DataFrame:
    return df.select("inode_id", *(F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "inode_id"))


def _edges(deltas: DataFrame, at: int, p: str) -> DataFrame:
    return tree.parents(deltas, at).select(F.col("child_id").alias("inode_id"), F.col("parent_id").alias(f"{p}_edge_parent"), F.col("display_name").alias(f"{p}_edge_name"), F.col("name_key").alias(f"{p}_edge_key"), F.col("seq").alias(f"{p}_edge_seq"))


def net_change(fork: DataFrame, after: int, through: int, max_depth: int = S.MAX_DEPTH) -> DataFrame:
    """Touched inodes whose state at the end differs from the start: flags binding, content, attributes, access, visibility."""
    t = stored(touched(fork, after, through), "touched")
    a, b = _side(states(fork, after, t, max_depth), "base"), _side(states(fork, through, t, max_depth), "ours")
    rows = t.join(a, "inode_id", "left").join(b, "inode_id", "left").join(_edges(fork, after, "base"), "inode_id", "left").join(_edges(fork, through, "ours"), "inode_id", "left")
    ne = lambda c: ~F.col(f"base_{c}").eqNullSafe(F.col(f"ours_{c}"))
    flags = {
        "binding": ne("edge_parent") | ne("edge_name"),
        "content": ne("content_id"),
        "attributes": ne("attributes"),
        "access": ne("grants") | ne("boundary"),
        "visibility": F.col("base_path").isNull() != F.col("ours_path").isNull(),
    }
    for k, v in flags.items():
        rows = rows.withColumn(f"changed_{k}", v)
    return rows.where(" or ".join(f"changed_{k}" for k in flags))


def classify(fork: DataFrame, target: DataFrame, after: int, through: int, target_head: int, fork_point: int, own_seqs: DataFrame | None = None, max_depth: int = S.MAX_DEPTH) -> DataFrame:
    """inode_id, action (create, delete, restore, move, update, move_update or none), conflict kind, and the flags behind them.

    own_seqs: sequences of the target that are merges of this fork."""
    n = stored(net_change(fork, after, through, max_depth), "net")
    ids = n.select("inode_id")
    theirs = _side(states(target, target_head, ids, max_depth), "theirs").join(_edges(target, target_head, "theirs"), "inode_id", "left")
    hidden = tree.hidden_roots(target, target_head).select(F.col("root_id").alias("inode_id"), F.col("deletion_seq").alias("theirs_deletion_seq"))
    rows = n.join(theirs, "inode_id", "left").join(hidden, "inode_id", "left")
    marks = {c: f"theirs_{c}" for c in ("edge_seq", "revision_seq", "attributes_seq", "access_seq", "deletion_seq")}
    foreign = {k: F.coalesce(F.col(c) > fork_point, F.lit(False)) for k, c in marks.items()}
    if own_seqs is not None:
        for k, c in marks.items():
            mine = own_seqs.select(F.col("seq").alias(c), F.lit(True).alias(f"mine_{k}"))
            rows = rows.join(mine, c, "left")
            foreign[k] = foreign[k] & F.col(f"mine_{k}").isNull()
    made, seen, edge = F.col("theirs_inode_kind").isNotNull(), F.col("theirs_path").isNotNull(), F.col("theirs_edge_seq").isNotNull()
    ours_seen, ours_edge = F.col("ours_path").isNotNull(), F.col("ours_edge_seq").isNotNull()
    ne = lambda c: ~F.col(f"theirs_{c}").eqNullSafe(F.col(f"ours_{c}"))
    own_deletion = F.col("theirs_deletion_seq").isNotNull() & ~foreign["deletion_seq"]
    up = {
        "content": F.col("changed_content") & ne("content_id"),
        "attributes": F.col("changed_attributes") & ne("attributes"),
        "access": F.col("changed_access") & (ne("grants") | ne("boundary")),
    }
    updates = F.when(up["content"] & foreign["revision_seq"], "content").when(up["attributes"] & foreign["attributes_seq"], "attributes").when(up["access"] & foreign["access_seq"], "access")
    any_update = up["content"] | up["attributes"] | up["access"]
    moves = F.col("changed_binding") & (ne("edge_parent") | ne("edge_name"))
    deleting, undeleting = made & ~ours_seen & edge, made & ours_seen & ours_edge & ~edge
    replaced = F.when(foreign["edge_seq"], "binding")
    conflict = (
        F.when(~made, None)
        .when(deleting & seen, F.coalesce(replaced, F.when(foreign["revision_seq"], "content")))
        .when(~ours_seen, None)
        .when(undeleting & ~own_deletion, "visibility")
        .when(undeleting, updates)
        .otherwise(F.coalesce(F.when(moves, replaced), updates))
    )
    action = (
        F.when(~made, F.when(ours_seen, "create").otherwise("none"))
        .when(~ours_seen, F.when(edge & seen, "delete").otherwise("none"))
        .when(undeleting, F.when(own_deletion, "restore").otherwise("none"))
        .when(moves & any_update, "move_update").when(moves, "move").when(any_update, "update").otherwise("none")
    )
    rows = rows.withColumn("action", action).withColumn("conflict", conflict)
    kind = F.coalesce("ours_inode_kind", "theirs_inode_kind")
    out = rows.select("inode_id", kind.alias("inode_kind"), "action", "conflict", "theirs_path", "ours_path", "ours_edge_parent", "ours_edge_name", "ours_edge_key", *(f"changed_{k}" for k in ("binding", "content", "attributes", "access", "visibility")), "last_touch_seq")
    out = stored(out, "classified")
    below = subtree_conflicts(out, target, fork_point, target_head, max_depth)
    return out.join(below.withColumn("below", F.lit(True)), "inode_id", "left").withColumn("conflict", F.coalesce("conflict", F.when(F.col("below"), "subtree"))).drop("below")


def subtree_conflicts(plan: DataFrame, target: DataFrame, fork_point: int, target_head: int, max_depth: int = S.MAX_DEPTH) -> DataFrame:
    """Directories that the plan deletes or moves and below which the target has changed since the fork point."""
    dirs = plan.where("inode_kind = 'directory' and action in ('delete', 'move', 'move_update') and conflict is null").select(F.col("inode_id").alias("dir_id"))
    fresh = target.where((F.col("seq") > fork_point) & (F.col("seq") <= target_head)).select("inode_id").distinct()
    up = tree.closure(target, target_head, max_depth, fresh).where("depth > 0")
    return up.join(dirs, up["ancestor_id"] == dirs["dir_id"]).select(F.col("dir_id").alias("inode_id")).distinct()


def name_conflicts(plan: DataFrame, target: DataFrame, target_head: int) -> DataFrame:
    """Takers of a name that the target has bound to another inode which the plan neither moves nor deletes, or which conflicts;
    repeated until no holder turns from free to conflicting."""
    takers = plan.where("conflict is null and action in ('create', 'restore', 'move', 'move_update')").select("inode_id", F.col("ours_edge_parent").alias("parent_id"), F.col("ours_edge_key").alias("name_key"))
    held = tree.slots(target, target_head).where("bound").select("parent_id", "name_key", F.col("child_id").alias("holder"))
    pairs = takers.join(held, ["parent_id", "name_key"]).where("inode_id <> holder")
    leaving = plan.where("conflict is null and action in ('delete', 'move', 'move_update')").select(F.col("inode_id").alias("holder"))
    bad = pairs.join(leaving, "holder", "left_anti").select("inode_id", "holder")
    n = -1
    while (now := bad.count()) != n:
        n = now
        more = pairs.join(bad.select(F.col("inode_id").alias("holder")).distinct(), "holder").select("inode_id", "holder")
        bad = bad.unionByName(more).distinct()
    return bad


def replay_skipped(plan: DataFrame, target: DataFrame, target_head: int, max_depth: int = S.MAX_DEPTH) -> DataFrame:
    """What a replay leaves out: conflicting inodes, and those that the fork made or put below one of them (``dependency``)."""
    bad = plan.where("conflict is not null").select("inode_id", F.col("conflict").alias("reason"))
    edges = plan.where("ours_edge_parent is not null").select(F.col("inode_id").alias("child_id"), F.col("ours_edge_parent").alias("parent_id"))
    c = tree.chains(edges, max_depth).select("child_id", F.explode(F.transform("chain", lambda e: e["parent_id"])).alias("up"))
    dep = c.join(bad.select(F.col("inode_id").alias("up")), "up", "left_semi").select(F.col("child_id").alias("inode_id")).distinct()
    return bad.unionByName(dep.join(bad, "inode_id", "left_anti").withColumn("reason", F.lit("dependency")))


def split_hint(fork: DataFrame, after: int, through: int, most: int) -> int:
    """Largest end of the range with at most so many touched inodes (the first commit at least)."""
    from pyspark.sql import Window

    first = fork.where((F.col("seq") > after) & (F.col("seq") <= through)).groupBy("inode_id").agg(F.min("seq").alias("seq"))
    per = first.groupBy("seq").agg(F.count("*").alias("n"))
    # the first commits alone can decide: each brings at least one inode
    few = per.orderBy("seq").limit(most + 1)
    total = few.withColumn("total", F.sum("n").over(Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    over = total.where(F.col("total") > most).agg(F.min("seq")).first()[0]
    return through if over is None else max(after + 1, over - 1)
