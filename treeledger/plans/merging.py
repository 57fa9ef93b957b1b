"""A merge from its plan to its operations, and the loop of planning, resolving and planning again.

The order of the operations follows from which change waits for which. Changes that wait for nothing, or only for such, are peeled
off in rounds, all of a round at once; so are those that nothing waits for, from the end. What is left (rings of names,
long chains of renames, and what lies between) is ordered by ``ordered``, each connected part in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import merge, tree
from ..sources.shared import stored
from .ordering import MAKES, TAKES_PLACE, ordered

#: Rounds of peeling, from each side (fixed value).
ROUNDS = 8
_OPERATIONS = ["position", "inode_id", "action", "parent_id", "name"]


def free_of_conflicts(plan: DataFrame, target: DataFrame, target_head: int) -> DataFrame:
    """The plan with the takers of held names in conflict (``name``) too."""
    taken = merge.name_conflicts(plan, target, target_head).select("inode_id").distinct().withColumn("named", F.lit("name"))
    return plan.join(taken, "inode_id", "left").withColumn("conflict", F.coalesce("conflict", "named")).drop("named")


def _waits(todo: DataFrame, slots: DataFrame) -> DataFrame:
    """inode_id, on: a taker of a place waits for the making of its parent and for who holds its name; a deletion for those that leave it."""
    takes = todo.where(F.col("action").isin(*TAKES_PLACE))
    makes = todo.where(F.col("action").isin(*MAKES)).select(F.col("inode_id").alias("on"))
    parent = takes.select("inode_id", F.col("parent").alias("on")).join(makes, "on", "left_semi")
    held = slots.select(F.col("parent_id").alias("parent"), F.col("name_key").alias("name"), F.col("child_id").alias("on"))
    holder = takes.join(held, ["parent", "name"]).select("inode_id", "on").join(todo.select(F.col("inode_id").alias("on")), "on", "left_semi")
    movers = slots.join(todo.where("action = 'move'").select(F.col("inode_id").alias("child_id")), "child_id", "left_semi")
    leaving = movers.select(F.col("parent_id").alias("inode_id"), F.col("child_id").alias("on")).join(todo.where("action = 'delete'").select("inode_id"), "inode_id", "left_semi")
    return parent.select("inode_id", "on").unionByName(holder.select("inode_id", "on")).unionByName(leaving).where("inode_id <> on").distinct()


def _peeled(waits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """inode_id, side, round of what can be peeled off, and the waits among the rest. Side 0 goes before the rest and in order of its
    rounds, side 2 after it and against that order."""
    out = []
    for side, a, b in ((0, "inode_id", "on"), (2, "on", "inode_id")):
        for k in range(ROUNDS):
            if waits.isEmpty():
                return reduce(DataFrame.unionByName, out) if out else waits.select("inode_id", F.lit(0).alias("side"), F.lit(0).alias("round")), waits
            free = waits.select(F.col(b).alias("free")).distinct().join(waits.select(F.col(a).alias("free")).distinct(), "free", "left_anti")
            free = stored(free, "free")
            if free.isEmpty():
                break
            out.append(free.select(F.col("free").alias("inode_id"), F.lit(side).alias("side"), F.lit(k if side == 0 else -k).alias("round")))
            # those whose only waits were these go in the next round, though no wait of them is left
            rest = stored(waits.join(free.withColumnRenamed("free", b), b, "left_anti"), "waits")
            ends = waits.select(F.col(a).alias("inode_id")).distinct()
            ends = ends.join(rest.select(F.col("inode_id")).unionByName(rest.select(F.col("on").alias("inode_id"))).distinct(), "inode_id", "left_anti")
            out.append(stored(ends.select("inode_id", F.lit(side).alias("side"), F.lit(k + 1 if side == 0 else -k - 1).alias("round")), "ends"))
            waits = rest
    return reduce(DataFrame.unionByName, out) if out else waits.limit(0).select("inode_id", F.lit(0).alias("side"), F.lit(0).alias("round")), waits


def _parts(waits: DataFrame) -> DataFrame:
    """inode_id, part: the least inode of its connected part. Labels spread over the waits and then to their own label, until none falls."""
    both = waits.unionByName(waits.select(F.col("on").alias("inode_id"), F.col("inode_id").alias("on")))
    both = stored(both.distinct(), "both")
    label = stored(both.groupBy("inode_id").agg(F.min("on").alias("m")).select("inode_id", F.least("inode_id", "m").alias("part")), "labels")
    while True:
        near = both.join(label.select(F.col("inode_id").alias("on"), F.col("part").alias("p")), "on").groupBy("inode_id").agg(F.min("p").alias("p"))
        own = label.select(F.col("inode_id").alias("part"), F.col("part").alias("q"))
        new = stored(label.join(near, "inode_id").join(own, "part").select("inode_id", F.least("part", "p", "q").alias("part"), (F.least("p", "q") < F.col("part")).alias("fell")), "labels")
        label = new.select("inode_id", "part")
        if new.where("fell").isEmpty():
            return label


def _ordered_part(table: pa.Table) -> pa.Table:
    """Rows of changes (with an action) and of places that are held (without) of one part: its operations in order."""
    changes, names = {}, {}
    for r in table.to_pylist():
        if r["action"] is None:
            names[r["parent"], r["name"]] = r["inode_id"]
        else:
            changes[r["inode_id"]] = {"action": r["action"], "parent": r["parent"], "name": r["name"]}
    rows = [{"part": table["part"][0].as_py(), "place": k, "inode_id": c["inode_id"], "action": c["action"], "parent": c.get("parent"), "name": c.get("name")} for k, c in enumerate(ordered(changes, names))]
    schema = pa.schema([("part", pa.int64()), ("place", pa.int64()), ("inode_id", pa.int64()), ("action", pa.string()), ("parent", pa.int64()), ("name", pa.string())])
    return pa.Table.from_pylist(rows, schema)


def execution(plan: DataFrame, target: DataFrame, target_head: int) -> DataFrame:
    """position, inode_id, action, parent_id, name: the operations of a plan's changes without conflict, in an order in which each can
    be applied. Changes of state alone come last."""
    every = stored(plan.where("conflict is null and action <> 'none'").select("inode_id", F.regexp_replace("action", "_?update$", "").alias("action"), F.col("action").endswith("update").alias("updates"), F.col("ours_edge_parent").alias("parent"), F.col("ours_edge_key").alias("name"), F.col("ours_edge_name").alias("shown")), "changes")
    todo = every.where("action <> ''")
    slots = tree.slots(target, target_head).where("bound").select("parent_id", "name_key", "child_id")
    wanted = todo.where("parent is not null").select(F.col("parent").alias("parent_id"), F.col("name").alias("name_key")).distinct()
    slots = stored(slots.join(wanted, ["parent_id", "name_key"], "left_semi").unionByName(slots.join(todo.select(F.col("inode_id").alias("child_id")), "child_id", "left_semi")).distinct(), "held")
    peeled, waits = _peeled(stored(_waits(todo, slots), "waits"))
    place = peeled.groupBy("inode_id").agg(F.min(F.struct("side", "round")).alias("p")).select("inode_id", "p.side", "p.round")
    first = F.when(F.col("action").isin(*MAKES), 0).otherwise(1)
    plain = todo.join(place, "inode_id", "left").select(F.coalesce("side", F.lit(0)).alias("side"), F.coalesce("round", F.lit(0)).alias("round"), first.alias("rank"), F.col("inode_id").alias("last"), "inode_id", "action", "parent", "name", "shown")
    parts = [plain]
    if not waits.isEmpty():
        part = _parts(waits)
        mine = todo.join(part, "inode_id").select("part", "inode_id", "action", "parent", "name")
        places = slots.select(F.col("child_id").alias("inode_id"), F.col("parent_id").alias("parent"), F.col("name_key").alias("name"))
        at = places.join(part, "inode_id").unionByName(places.join(mine.where("parent is not null").select("part", "parent", "name"), ["parent", "name"]).select("inode_id", "parent", "name", "part")).distinct()
        rows = mine.unionByName(at.select("part", "inode_id", F.lit(None).cast("string").alias("action"), "parent", "name"))
        done = rows.groupBy("part").applyInArrow(_ordered_part, "part bigint, place bigint, inode_id bigint, action string, parent bigint, name string")
        shown = todo.select("inode_id", "shown")
        parts = [plain.join(part.select("inode_id"), "inode_id", "left_anti").select(*plain.columns)]
        parts.append(done.join(shown, "inode_id", "left").select(F.lit(1).alias("side"), F.lit(0).alias("round"), "part", "place", "inode_id", "action", "parent", "name", F.when(F.col("action") == "park", F.col("name")).otherwise(F.col("shown")).alias("shown")).toDF(*plain.columns[:2], "rank", "last", *plain.columns[4:]))
    parts.append(every.where("updates").select(F.lit(3).alias("side"), F.lit(0).alias("round"), F.lit(0).alias("rank"), F.col("inode_id").alias("last"), "inode_id", F.lit("update").alias("action"), F.lit(None).cast("bigint").alias("parent"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("shown")))
    order = ["side", "round", "rank", "last"]
    rows = reduce(DataFrame.unionByName, (p.withColumn("rank", F.col("rank").cast("bigint")) for p in parts))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = stored(rows.withColumn("_slice", F.shiftright("_id", 33)), "operations")
    counts = rows.groupBy("_slice").agg(F.count("*").alias("n"), F.min("_id").alias("_low"))
    before = counts.select("_slice", "_low", (F.sum("n").over(Window.orderBy("_slice")) - F.col("n")).alias("before"))  # a row a task
    gone = F.col("action") == "delete"
    return rows.join(F.broadcast(before), "_slice").select((F.col("before") + F.col("_id") - F.col("_low")).alias("position"), "inode_id", "action", F.when(~gone, F.col("parent")).alias("parent_id"), F.when(~gone, F.coalesce("shown", "name")).alias("name")).select(*_OPERATIONS)


def session(fork: DataFrame, target: DataFrame, after: int, through: int, target_head: int, fork_point: int, resolve: Callable[[DataFrame], DataFrame], max_depth: int = S.MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """Operations of the merge and what it leaves out (inode_id, reason).

    Conflicts go to ``resolve`` (inode_id, conflict to inode_id, side): ``ours`` is applied in spite of the target, ``theirs`` is left
    out with all that depends on it. What resolving brings up newly is asked for again; a conflict left unanswered is left out.
    """
    plan = stored(merge.classify(fork, target, after, through, target_head, fork_point, max_depth=max_depth), "plan")
    told: DataFrame | None = None
    while True:
        now = stored(free_of_conflicts(plan, target, target_head), "plan")
        conflicts = now.where("conflict is not null").select("inode_id", "conflict")
        fresh = conflicts if told is None else conflicts.join(told, "inode_id", "left_anti")
        if fresh.isEmpty():
            break
        sides = resolve(fresh).where("side in ('ours', 'theirs')").select("inode_id", "side")
        answered = fresh.select("inode_id").join(sides, "inode_id", "left").withColumn("side", F.coalesce("side", F.lit("theirs")))
        told = stored(answered if told is None else told.unionByName(answered), "sides")
        forced = told.where("side = 'ours'").select("inode_id", F.lit(True).alias("forced"))
        # a name that the target holds can't be forced; all else is applied as the fork has it
        plan = stored(now.join(forced, "inode_id", "left").withColumn("conflict", F.when(F.col("forced") & (F.col("conflict") != "name"), None).otherwise(F.col("conflict"))).drop("forced"), "plan")
    left_out = stored(merge.replay_skipped(now, target, target_head, max_depth), "left-out")
    kept = now.join(left_out.select("inode_id"), "inode_id", "left_anti")
    return execution(kept, target, target_head), left_out
