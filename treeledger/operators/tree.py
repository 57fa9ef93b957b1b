"""The tree as of a sequence: parents, ancestor chains, visibility and paths.

Chains are built by pointer doubling: after k joins every node holds its nearest 2^k ancestors. Every step is written to the
shared folder and takes only chains that may still grow, so a tree costs as many as its own depth asks for; one deeper than
is legal (128), or with a cycle, is refused. All chains soon lead to the few nodes near the root, so the rows that wait for one of these
are dealt out. Reads of a few inodes climb from these alone: their edges are picked
from the ledger level by level, and the chains are built of those.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..sources.shared import stored
from . import families
from .asof import newest


class TooDeep(ValueError):
    """A chain of parents is longer than a legal tree is deep, or leads back to itself."""


def parents(deltas: DataFrame, at: int) -> DataFrame:
    """child_id, child_kind, parent_id, name_key, display_name, seq of every bound child."""
    return newest(families.bindings(deltas), ["child_id"], at).where("bound").select("child_id", "child_kind", "parent_id", "name_key", "display_name", "seq", "delta_index")


def slots(deltas: DataFrame, at: int) -> DataFrame:
    """The newest row of every (parent, name); its child counts only if it is bound."""
    return newest(families.bindings(deltas), ["parent_id", "name_key"], at)


def hidden_roots(deltas: DataFrame, at: int, of: DataFrame | None = None) -> DataFrame:
    """root_id and deletion_seq of every subtree whose newest tombstone is set; ``of``: only of these inodes."""
    rows = families.tombstones(deltas)
    if of is not None:
        rows = rows.join(of.select(F.col("inode_id").alias("root_id")), "root_id", "left_semi")
    return newest(rows, ["root_id"], at).where("is_set").select("root_id", F.col("seq").alias("deletion_seq"), "inode_kind")


def edges_above(deltas: DataFrame, at: int, of: DataFrame, max_depth: int = S.MAX_DEPTH) -> tuple[DataFrame, int]:
    """The newest binding of the given inodes (inode_id) and of all their ancestors, bound or not, and how many levels that is. Each
    level reads the bindings of that level's nodes alone, and the climb ends at the root."""
    rows = families.bindings(deltas).where(F.col("seq") <= at)
    level = of.select(F.col("inode_id").alias("child_id")).distinct()
    out, levels = None, 0
    while levels <= max_depth:
        got = stored(newest(rows.join(level, "child_id", "left_semi"), ["child_id"]), "climb")
        out, levels = got if out is None else out.unionByName(got), levels + 1
        above = got.where(F.col("parent_id") != S.ROOT)
        if above.isEmpty():
            return out.dropDuplicates(["child_id"]), levels  # ancestors are met at several levels
        level = above.select(F.col("parent_id").alias("child_id")).distinct()
    raise TooDeep(f"over {max_depth} levels")


#: Rows of one key that a task of a join gets at most, about (fixed value).
SHARE = 100_000


def join_dealt(rows: DataFrame, facts: DataFrame, key: str, by: str) -> DataFrame:
    """rows, left joined with facts (one row a key). Keys of over SHARE rows are dealt out by a hash of column ``by``, and their facts
    repeated as often; such keys are told to all tasks, one at most for every SHARE rows."""
    heavy = [(r[key], -(-r["count"] // SHARE)) for r in rows.groupBy(key).count().where(F.col("count") > SHARE).collect()]
    if not heavy:
        return rows.join(facts, key, "left")
    told = F.broadcast(rows.sparkSession.createDataFrame(heavy, f"{key} bigint, _parts bigint"))
    parts = F.coalesce("_parts", F.lit(1))
    left = rows.join(told, key, "left").withColumn("_part", F.pmod(F.xxhash64(by), parts)).drop("_parts")
    right = facts.join(told, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("_parts")
    return left.join(right, [key, "_part"], "left").drop("_part")


def chains(edges: DataFrame, max_depth: int = S.MAX_DEPTH, cyclic: bool = False, levels: int | None = None) -> DataFrame:
    """For edges (child_id, parent_id, …): child_id, chain (the node, then its ancestors, nearest first; a struct of the edge's
    columns each) and tip, the node above the last one. A node without an edge ends a chain. Chains that still grow at the
    greatest depth are refused, unless ``cyclic`` ones are asked for. Where the levels are known, there are no more steps than these need."""
    now = stored(edges.select("child_id", F.array(F.struct(*edges.columns)).alias("chain"), F.col("parent_id").alias("tip")), "chains")
    ends = F.lit(False) if not now.where(F.col("child_id") == S.ROOT).isEmpty() else F.col("tip") == S.ROOT
    ended, now, reach = [now.where(ends)], now.where(~ends), 1
    while reach <= (max_depth if levels is None else levels - 1) and not now.isEmpty():
        up = reduce(DataFrame.unionByName, [*ended, now]).select(F.col("child_id").alias("tip"), F.col("chain").alias("more"), F.col("tip").alias("next"))
        found = F.col("more").isNotNull()
        step = join_dealt(now, up, "tip", "child_id").select("child_id", F.when(found, F.concat("chain", "more")).otherwise(F.col("chain")).alias("chain"), F.when(found, F.col("next")).otherwise(F.col("tip")).alias("tip"), found.alias("grew"))
        step = stored(step, "chains")
        reach *= 2
        if levels is None and not cyclic and reach > max_depth and not step.where(F.size("chain") > max_depth).isEmpty():
            raise TooDeep(f"a chain of over {max_depth} parents")
        ended.append(step.where(~F.col("grew") | ends).drop("grew"))
        now = step.where(F.col("grew") & ~ends).drop("grew")
    return reduce(DataFrame.unionByName, [*ended, now])


def _bound(deltas: DataFrame, at: int, max_depth: int, of: DataFrame | None) -> tuple[DataFrame, int | None]:
    """The bound edges of the whole tree, or of the given inodes and what is above them; the levels of the latter."""
    if of is None:
        return parents(deltas, at), None
    edges, levels = edges_above(deltas, at, of, max_depth)
    return edges.where("bound"), levels


def cycles(edges: DataFrame, max_depth: int = S.MAX_DEPTH) -> DataFrame:
    """child_id of nodes that are their own ancestors."""
    c = chains(edges, max_depth, cyclic=True)
    return c.where(F.exists("chain", lambda e: e["parent_id"] == F.col("child_id"))).select("child_id")


def _made(deltas: DataFrame, at: int, of: DataFrame | None) -> DataFrame:
    rows = families.inodes(deltas)
    if of is not None:
        rows = rows.join(of.select("inode_id"), "inode_id", "left_semi")
    return newest(rows, ["inode_id"], at)


def closure(deltas: DataFrame, at: int, max_depth: int = S.MAX_DEPTH, of: DataFrame | None = None) -> DataFrame:
    """inode_id, ancestor_id, depth over bound edges, each node its own ancestor at depth 0; ``of``: only of these inodes."""
    edges, levels = _bound(deltas, at, max_depth, of)
    c = chains(edges.select("child_id", "parent_id"), max_depth, levels=levels)
    if of is not None:
        c = c.join(of.select(F.col("inode_id").alias("child_id")), "child_id", "left_semi")
    up = c.select(F.col("child_id").alias("inode_id"), F.posexplode(F.transform("chain", lambda e: e["parent_id"])).alias("pos", "ancestor_id"))
    return up.select("inode_id", "ancestor_id", (F.col("pos") + 1).alias("depth")).unionByName(_made(deltas, at, of).select("inode_id", F.col("inode_id").alias("ancestor_id"), F.lit(0).alias("depth")))


def paths(deltas: DataFrame, at: int, max_depth: int = S.MAX_DEPTH, of: DataFrame | None = None) -> DataFrame:
    """Every visible inode: inode_id, inode_kind, parent_id, display_name, path, path_keys, depth; ``of``: only of these inodes.
    Hidden edges are marked before the climb, so visibility needs no join on closure pairs."""
    edges, levels = _bound(deltas, at, max_depth, of)
    hidden = hidden_roots(deltas, at, None if of is None else edges.select(F.col("child_id").alias("inode_id"))).select(F.col("root_id").alias("child_id"), F.lit(True).alias("hidden"))
    edges = edges.select("child_id", "parent_id", "name_key", "display_name", "child_kind").join(hidden, "child_id", "left").withColumn("hidden", F.coalesce("hidden", F.lit(False)))
    c = chains(edges, max_depth, levels=levels).where((F.col("tip") == S.ROOT) & ~F.exists("chain", lambda e: e["hidden"]))
    if of is not None:
        c = c.join(of.select(F.col("inode_id").alias("child_id")), "child_id", "left_semi")
    down = F.reverse("chain")
    own = F.col("chain")[0]
    rows = c.select(F.col("child_id").alias("inode_id"), own["child_kind"].alias("inode_kind"), own["parent_id"].alias("parent_id"), own["display_name"].alias("display_name"), F.concat(F.lit("/"), F.array_join(F.transform(down, lambda e: e["display_name"]), "/")).alias("path"), F.transform(down, lambda e: e["name_key"]).alias("path_keys"), F.size("chain").alias("depth"))
    root = _made(deltas, at, of).where(F.col("inode_id") == S.ROOT)
    return rows.unionByName(root.select("inode_id", "inode_kind", F.lit(None).cast("bigint").alias("parent_id"), F.lit("").alias("display_name"), F.lit("/").alias("path"), F.array().cast("array<string>").alias("path_keys"), F.lit(0).alias("depth")))


def at_or_below(paths_: DataFrame, scope: list[str]) -> DataFrame:
    """Paths whose name keys begin with the scope's."""
    return paths_.where(F.slice("path_keys", 1, len(scope)) == F.array(*map(F.lit, scope)).cast("array<string>")) if scope else paths_


def readable(deltas: DataFrame, at: int, floor: int, max_depth: int = S.MAX_DEPTH) -> DataFrame:
    """inode_id, allowed: whether an inode may be read by id. The nearest tombstoned ancestor-or-self decides: allowed if it was
    deleted after the floor. A deleted root climbs on from the parent it was deleted from; a broken chain refuses."""
    last = newest(families.bindings(deltas), ["child_id"], at).select("child_id", "parent_id")
    hidden = hidden_roots(deltas, at).select(F.col("root_id").alias("child_id"), "deletion_seq")
    c = chains(last.join(hidden, "child_id", "left"), max_depth)
    nearest = F.element_at(F.filter("chain", lambda e: e["deletion_seq"].isNotNull()), 1)["deletion_seq"]
    nearest = F.when(F.size(F.filter("chain", lambda e: e["deletion_seq"].isNotNull())) > 0, nearest)
    out = c.select(F.col("child_id").alias("inode_id"), F.when(nearest.isNotNull(), nearest > floor).otherwise(F.col("tip") == S.ROOT).alias("allowed"))
    return out.unionByName(newest(families.inodes(deltas), ["inode_id"], at).where(F.col("inode_id") == S.ROOT).select("inode_id", F.lit(True).alias("allowed")))
