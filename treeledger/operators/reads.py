"""Reads at a sequence: listings, stat, revisions, attributes, trash, files and rights.

Reads by name go down from the root by name key, reads by inode climb from the inodes asked for; only reads of whole trees
(``paths``, ``walk`` and what is built on them) build the whole tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.names import fold_name, path_keys
from ..sources.shared import stored
from . import families, tree
from .asof import newest


class BelowRetentionFloor(ValueError):
    """What is asked for lies below the retention floor."""


def above_floor(seq: int, floor: int) -> int:
    if seq < floor:
        raise BelowRetentionFloor(f"below_retention_floor: {seq} < {floor}")
    return seq


class View:
    """A ledger read at one sequence, which may not lie below the floor. Paths are made once; ``cached`` keeps them for several reads."""

    def __init__(self, deltas: DataFrame, at: int, max_depth: int = S.MAX_DEPTH, floor: int = 0) -> None:
        self.deltas, self.at, self.max_depth = deltas, above_floor(at, floor), max_depth
        self._paths: DataFrame | None = None

    def paths(self) -> DataFrame:
        if self._paths is None:
            self._paths = tree.paths(self.deltas, self.at, self.max_depth)
        return self._paths

    def cached(self) -> View:
        self._paths = self.paths().persist()
        return self

    def _of(self, rows: DataFrame, of: DataFrame | None) -> DataFrame:
        return rows if of is None else rows.join(of.select("inode_id"), "inode_id", "left_semi")

    def revision(self, of: DataFrame | None = None) -> DataFrame:
        """The newest revision of every file, or of the given inodes."""
        return newest(self._of(families.revisions(self.deltas), of), ["inode_id"], self.at).select("inode_id", "revision_no", "content_id", "size_bytes", F.col("seq").alias("revised_seq"))

    def attributes(self, of: DataFrame | None = None) -> DataFrame:
        return newest(self._of(families.attributes(self.deltas), of), ["inode_id"], self.at)

    def access(self) -> DataFrame:
        return newest(families.access(self.deltas), ["inode_id"], self.at)

    def _told(self, entries: DataFrame, of: DataFrame | None, include_attributes: bool) -> DataFrame:
        out = entries.join(self.revision(of), "inode_id", "left")
        if include_attributes:
            a = self.attributes(of).select("inode_id", "attributes_revision_no", "attributes")
            out = out.join(a, "inode_id", "left").withColumn("attributes_revision_no", F.coalesce("attributes_revision_no", F.lit(0))).withColumn("attributes", F.coalesce("attributes", F.create_map().cast("map<string,string>")))
        return out

    def entries(self, include_attributes: bool = False) -> DataFrame:
        """Paths with the file's revision; attributes only if asked, revision 0 and empty where none was written."""
        return self._told(self.paths(), None, include_attributes)

    # ---- by name

    def locate(self, path: str) -> tuple[int, str] | None:
        """Inode and path, as its names are written, of what a path names without regard to case; None if nothing visible is there.
        One filtered read a component."""
        at, told = S.ROOT, ""
        for part in filter(None, path.split("/")):
            slot = families.bindings(self.deltas).where((F.col("parent_id") == at) & (F.col("name_key") == fold_name(part)))
            row = newest(slot, ["parent_id", "name_key"], self.at).where("bound").first()
            if row is None:
                return None
            dead = newest(families.tombstones(self.deltas).where(F.col("root_id") == row["child_id"]), ["root_id"], self.at).where("is_set")
            if not dead.isEmpty():
                return None
            at, told = row["child_id"], f"{told}/{row['display_name']}"
        return at, told or "/"

    def children(self, parent: int) -> DataFrame:
        """The visible children of a visible directory: inode_id, inode_kind, display_name, name_key."""
        rows = newest(families.bindings(self.deltas).where(F.col("parent_id") == parent), ["parent_id", "name_key"], self.at).where("bound")
        rows = stored(rows.select(F.col("child_id").alias("inode_id"), F.col("child_kind").alias("inode_kind"), "display_name", "name_key"), "children")
        return rows.join(tree.hidden_roots(self.deltas, self.at, rows).select(F.col("root_id").alias("inode_id")), "inode_id", "left_anti")

    def listdir(self, path: str, after: str | None = None, limit: int | None = None, include_attributes: bool = False) -> DataFrame:
        """Visible children in order of name key; a page begins strictly after a name key. Nothing visible at the path: no rows."""
        found = self.locate(path)
        parent, told = found if found else (None, "/")
        rows = self.children(-1 if parent is None else parent)
        if after is not None:
            rows = rows.where(F.col("name_key") > after)
        if limit is not None:
            rows = rows.orderBy("name_key").limit(limit)
        rows = rows.withColumn("path", F.concat(F.lit("" if told == "/" else told), F.lit("/"), "display_name"))
        return self._told(rows, rows, include_attributes).orderBy("name_key")

    def resolve(self, paths: DataFrame) -> DataFrame:
        """paths: column path. Each distinct one that names a visible inode: path, inode_id, found_path. All go down together, a
        join a level; only bindings of the names asked for are read."""
        asked = stored(paths.select("path").distinct().withColumn("keys", path_keys("path")), "asked")
        named = asked.select(F.explode("keys").alias("name_key")).distinct()
        slot = newest(families.bindings(self.deltas).join(named, "name_key", "left_semi"), ["parent_id", "name_key"], self.at).where("bound")
        slot = stored(slot.select("parent_id", "name_key", "child_id", "display_name"), "slots")
        dead = tree.hidden_roots(self.deltas, self.at, slot.select(F.col("child_id").alias("inode_id"))).select(F.col("root_id").alias("child_id"))
        slot = slot.join(dead, "child_id", "left_anti")
        now = asked.select("path", "keys", F.lit(S.ROOT).cast("bigint").alias("inode_id"), F.lit("").alias("found_path"))
        for k in range(asked.agg(F.max(F.size("keys"))).first()[0] or 0):
            done, open_ = now.where(F.size("keys") <= k), now.where(F.size("keys") > k)
            step = open_.join(slot, (open_["inode_id"] == slot["parent_id"]) & (F.col("keys")[k] == slot["name_key"]))
            now = done.unionByName(step.select("path", "keys", F.col("child_id").alias("inode_id"), F.concat("found_path", F.lit("/"), "display_name").alias("found_path")))
        return now.select("path", "inode_id", F.when(F.col("found_path") == "", "/").otherwise(F.col("found_path")).alias("found_path"))

    def stat(self, paths: DataFrame) -> DataFrame:
        """paths: column path. Each with its entry, or found false."""
        found = stored(self.resolve(paths), "resolved")
        kinds = newest(self._of(families.inodes(self.deltas), found), ["inode_id"], self.at).select("inode_id", "inode_kind")
        ids = found.select("inode_id").distinct()
        return paths.join(self._told(found.join(kinds, "inode_id"), ids, True), "path", "left").withColumn("found", F.col("inode_id").isNotNull())

    # ---- by inode

    def stat_inodes(self, ids: DataFrame) -> DataFrame:
        """ids: column inode_id. Path and revision, or why there is none: ``never_created`` or ``not_visible``."""
        made = newest(self._of(families.inodes(self.deltas), ids), ["inode_id"], self.at).select("inode_id", F.lit(True).alias("made"))
        seen = tree.paths(self.deltas, self.at, self.max_depth, ids)
        out = ids.join(self._told(seen, ids, False), "inode_id", "left").join(made, "inode_id", "left")
        return out.withColumn("missing", F.when(F.col("path").isNull(), F.when(F.col("made"), F.lit("not_visible")).otherwise(F.lit("never_created"))))

    def revisions(self, inode: int, floor: int = 0, after: int | None = None, limit: int | None = None) -> DataFrame:
        """A file's revisions that are retained at a floor, newest first; a page begins below a revision number."""
        rows = families.revisions(self.deltas).where((F.col("inode_id") == inode) & (F.col("seq") <= self.at))
        oldest = rows.where(F.col("seq") <= floor).agg(F.max("revision_no")).first()[0] or 0
        rows = rows.where(F.col("revision_no") >= oldest)
        rows = (rows if after is None else rows.where(F.col("revision_no") < after)).orderBy(F.desc("revision_no"))
        return rows if limit is None else rows.limit(limit)

    # ---- the whole tree

    def walk(self, scope: list[str] = (), after: list[str] | None = None, limit: int | None = None) -> DataFrame:
        """Depth first, a directory before what is in it: the order of the arrays of name keys."""
        out = tree.at_or_below(self.entries(), list(scope))
        if after is not None:
            out = out.where(F.col("path_keys") > F.array(*map(F.lit, after)).cast("array<string>"))
        out = out.orderBy("path_keys")
        return out.limit(limit) if limit is not None else out

    def has_children(self) -> DataFrame:
        """Visible directories, and whether a non-recursive delete would refuse."""
        p = self.paths()
        full = p.select(F.col("parent_id").alias("inode_id")).where("inode_id is not null").distinct().withColumn("full", F.lit(True))
        return p.where("inode_kind = 'directory'").join(full, "inode_id", "left").select("inode_id", F.coalesce("full", F.lit(False)).alias("has_children"))

    def trash(self, floor: int) -> DataFrame:
        """Deletions after the floor that are not revoked, in order."""
        t = families.trash_rows(self.deltas).where(F.col("seq") <= self.at)
        gone = t.where("action = 'removed'").select("deletion_seq", "root_id")
        return t.where(F.col("action") == "listed").where(F.col("deletion_seq") > floor).join(gone, ["deletion_seq", "root_id"], "left_anti").orderBy("deletion_seq", "root_id")

    def files(self, with_deleted: bool = False) -> DataFrame:
        """Files in order of inode; deleted ones (made, not visible) on request, with a null path."""
        seen = self.entries().where("inode_kind = 'file'").select("inode_id", "path", "revision_no", "content_id")
        if not with_deleted:
            return seen.orderBy("inode_id")
        made = newest(families.inodes(self.deltas), ["inode_id"], self.at).where("inode_kind = 'file'").select("inode_id")
        return made.join(self.revision(), "inode_id", "left").join(seen.select("inode_id", "path"), "inode_id", "left").select("inode_id", "path", "revision_no", "content_id").orderBy("inode_id")

    def effective_rights(self, floor: int | None = None) -> DataFrame:
        """inode_id, principal, rights of visible inodes: own and ancestors' grants up to the nearest boundary; admin from the root only.
        With a floor also of what lies in the trash above it: a deleted root goes on at the parent that it was deleted from."""
        acc = self.access().select(F.col("inode_id").alias("child_id"), "boundary", "grants")
        if not acc.where(F.size("grants") > S.MAX_GRANTS).isEmpty():
            raise ValueError(f"over {S.MAX_GRANTS} grants on one inode")
        if floor is None:
            edges = tree.parents(self.deltas, self.at).select("child_id", "parent_id")
            seen = self.paths().select(F.col("inode_id").alias("child_id"))
        else:
            edges = newest(families.bindings(self.deltas), ["child_id"], self.at).select("child_id", "parent_id")
            seen = tree.readable(self.deltas, self.at, floor, self.max_depth).where("allowed").select(F.col("inode_id").alias("child_id"))
        c = tree.chains(edges.join(acc, "child_id", "left"), self.max_depth).join(seen, "child_id", "left_semi")
        wall = F.array_position(F.transform("chain", lambda e: F.coalesce(e["boundary"], F.lit(False))), True)
        reach = F.when(wall > 0, F.slice("chain", F.lit(1), wall.cast("int"))).otherwise(F.col("chain"))
        own = c.select(F.col("child_id").alias("inode_id"), F.explode(F.filter(reach, lambda e: e["grants"].isNotNull())).alias("g")).select("inode_id", F.explode("g.grants").alias("principal", "rights"))
        grants = own.select("inode_id", "principal", F.col("rights").bitwiseAND(S.ADMIN - 1).alias("rights"))
        root = acc.where(F.col("child_id") == S.ROOT).select(F.explode("grants").alias("principal", "rights"))  # MAX_GRANTS rows at most
        roots = newest(families.inodes(self.deltas), ["inode_id"], self.at).where(F.col("inode_id") == S.ROOT).select("inode_id")
        below = c.where(~(F.coalesce(wall, F.lit(0)) > 0)).select(F.col("child_id").alias("inode_id")).unionByName(roots).crossJoin(F.broadcast(root))
        return grants.unionByName(below.select("inode_id", "principal", "rights")).groupBy("inode_id", "principal").agg(F.bit_or("rights").alias("rights"))


def masked(entries: DataFrame, rights: DataFrame, principal: str, right: str = "read") -> DataFrame:
    """Entries with content and attributes left out where the principal lacks the right."""
    bit = 1 << S.RIGHTS.index(right)
    may = rights.where((F.col("principal") == principal) & (F.col("rights").bitwiseAND(bit) != 0)).select("inode_id", F.lit(True).alias("may"))
    out = entries.join(may, "inode_id", "left").withColumn("readable", F.coalesce("may", F.lit(False))).drop("may")
    for c in ("content_id", "attributes"):
        if c in entries.columns:
            out = out.withColumn(c, F.when(F.col("readable"), F.col(c)))
    return out
