"""Planning a commit: operations and preconditions to deltas, on the driver.

Writes are sequential in a namespace, so a commit is planned by one process over the few entities that its operations
name. ``Tree`` holds those; ``load`` reads them from a ledger. Operation k sees what 0 .. k-1 did, and all or none apply.
Preconditions that are many and of no one commit are checked together, by joins (``holding``).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.names import fold_name, name_key
from ..operators import families, tree
from ..operators.asof import newest
from ..operators.reads import View
from ..sources.shared import stored

MAX_OPERATIONS, MAX_PRECONDITIONS = 4_096, 1_024


class Refused(Exception):
    """The commit as a whole is refused; ``code`` says why and ``index`` which operation or precondition it was."""

    def __init__(self, code: str, index: int = -1) -> None:
        super().__init__(f"{code} at {index}")
        self.code, self.index = code, index


@dataclass
class Node:
    kind: str
    parent: int | None = None
    name: str | None = None
    bound_at: tuple[int, int] | None = None
    revision: int = 0
    content: int | None = None
    revisions: dict[int, int] = field(default_factory=dict)
    attributes_no: int = 0
    attributes: dict[str, str] = field(default_factory=dict)
    access_no: int = 0
    deleted: tuple[int, int, str] | None = None
    """(deletion sequence, parent, name) while its own deletion stands."""


class Tree:
    """The part of a tree that a commit works on."""

    def __init__(self, head: int = 0) -> None:
        self.head, self.nodes = head, {S.ROOT: Node("directory")}
        self._last: int | None = None
        self.whole = True
        self.made: set[int] = set()
        self.free: set[tuple[int, str]] = set()
        """Whether all of the namespace is here. Of a part, names are known to be free below inodes that a plan made, and where looked up."""
        self.names: dict[tuple[int, str], int] = {}
        self.below: dict[int, int] = {}
        """Inode of every bound (parent, name key), and how many are bound below an inode."""

    def own(self, inode: int) -> Node:
        """A node to change."""
        return self.nodes[inode]

    def place(self, inode: int, parent: int | None, name: str | None, at: tuple[int, int] | None = None) -> None:
        """Binds an inode to a place, or (parent None) to none."""
        n = self.own(inode)
        if n.parent is not None:
            self.names.pop((n.parent, fold_name(n.name)), None)
            self.free.add((n.parent, fold_name(n.name)))
            self.below[n.parent] = self.below.get(n.parent, 1) - 1
        n.parent, n.name, n.bound_at = parent, name, at
        if parent is not None:
            self.names[parent, fold_name(name)] = inode
            self.below[parent] = self.below.get(parent, 0) + 1

    def draft(self) -> Tree:
        """A tree to plan on: nodes are copied when they are first changed."""
        out = _Draft(self.head)
        out.nodes, out.names, out.below = dict(self.nodes), dict(self.names), dict(self.below)
        out.whole, out.made, out.free, out._last = self.whole, set(self.made), set(self.free), self._last
        return out

    @classmethod
    def load(cls, deltas: DataFrame, head: int, most: int = 100_000, of: DataFrame | None = None) -> Tree:
        """A whole small namespace, or of one of any size the inodes that the operations name (``of``: inode_id) with what is above them;
        ValueError beyond ``most`` inodes."""
        out, keep = cls(head), lambda rows, key: rows
        made = families.inodes(deltas)
        if of is None:
            edges = newest(families.bindings(deltas), ["child_id"], head)
        else:
            of = stored(of.select("inode_id").distinct(), "named")
            edges = tree.edges_above(deltas, head, of)[0]
            ids = of.unionByName(edges.select(F.col("child_id").alias("inode_id"))).unionByName(edges.select(F.col("parent_id").alias("inode_id")))
            ids = stored(ids.unionByName(of.sparkSession.createDataFrame([(S.ROOT,)], "inode_id bigint")).distinct(), "ids")
            keep = lambda rows, key: rows.join(ids.select(F.col("inode_id").alias(key)), key, "left_semi")
            out.whole, out._last = False, made.where(F.col("seq") <= head).agg(F.max("inode_id")).first()[0] or S.ROOT
        rows = newest(keep(made, "inode_id"), ["inode_id"], head).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} inodes: give the entities that the operations name")
        out.nodes = {r["inode_id"]: Node(r["inode_kind"]) for r in rows}
        out.nodes.setdefault(S.ROOT, Node("directory"))
        for r in edges.collect():
            n = out.nodes[r["child_id"]]
            if r["bound"]:
                out.place(r["child_id"], r["parent_id"], r["display_name"], (r["seq"], r["delta_index"]))
            else:
                n.deleted = (r["seq"], r["parent_id"], r["display_name"])
        if of is not None:
            left = edges.where("not bound").select("parent_id", "name_key").distinct()  # where a restoration would go
            out.free = {(r["parent_id"], r["name_key"]) for r in left.collect()}
            taken = newest(families.bindings(deltas).join(left, ["parent_id", "name_key"], "left_semi"), ["parent_id", "name_key"], head).where("bound")
            out.names |= {(r["parent_id"], r["name_key"]): r["child_id"] for r in taken.collect()}
            out.below = {r["parent_id"]: r["count"] for r in newest(keep(families.bindings(deltas), "parent_id"), ["parent_id", "name_key"], head).where("bound").groupBy("parent_id").count().collect()}
        hidden = {r["root_id"]: r["deletion_seq"] for r in tree.hidden_roots(deltas, head, None if of is None else ids).collect()}
        for i, n in out.nodes.items():
            n.deleted = (hidden[i], *n.deleted[1:]) if i in hidden and n.deleted else None
        for r in keep(families.revisions(deltas).where(F.col("seq") <= head), "inode_id").orderBy("revision_no").collect():
            n = out.nodes[r["inode_id"]]
            n.revision, n.content = r["revision_no"], r["content_id"]
            n.revisions[n.revision] = n.content
        for r in newest(keep(families.attributes(deltas), "inode_id"), ["inode_id"], head).collect():
            n = out.nodes[r["inode_id"]]
            n.attributes_no, n.attributes = r["attributes_revision_no"], dict(r["attributes"] or {})
        for r in newest(keep(families.access(deltas), "inode_id"), ["inode_id"], head).collect():
            out.nodes[r["inode_id"]].access_no = r["access_revision_no"]
        return out

    def child(self, parent: int, name: str) -> int | None:
        got = self.names.get((parent, fold_name(name)))
        if got is None and not self.whole and parent not in self.made and (parent, fold_name(name)) not in self.free:
            raise ValueError(f"not loaded: {name!r} below {parent}")
        return got

    def next_inode(self) -> int:
        if self._last is None:
            self._last = max(self.nodes)
        self._last += 1
        return self._last

    def above(self, inode: int):
        while inode != S.ROOT:
            n = self.nodes[inode]
            inode = n.parent if n.parent is not None else n.deleted[1] if n.deleted else S.ROOT
            yield inode

    def hidden(self, inode: int) -> bool:
        return any(self.nodes[i].deleted for i in (inode, *self.above(inode)))

    def resolve(self, path: str) -> int | None:
        at: int | None = S.ROOT
        for part in filter(None, path.split("/")):
            at = None if at is None else self.child(at, part)
        return None if at is None or self.hidden(at) else at


class _Draft(Tree):
    def __init__(self, head: int) -> None:
        super().__init__(head)
        self.copied: set[int] = set()

    def own(self, inode: int) -> Node:
        if inode not in self.copied:
            n = self.nodes[inode]
            self.nodes[inode] = replace(n, revisions=dict(n.revisions), attributes=dict(n.attributes))
            self.copied.add(inode)
        return self.nodes[inode]


def check(t: Tree, preconditions: list[dict]) -> None:
    """Raises Refused with the index of the first precondition that fails."""
    if len(preconditions) > MAX_PRECONDITIONS:
        raise Refused("too_many_preconditions")
    for i, p in enumerate(preconditions):
        node = t.nodes.get(p.get("inode_id", -1))
        at = t.resolve(p["path"]) if "path" in p else None
        ok = {
            "namespace_head": lambda p=p: t.head == p["seq"],
            "file_revision": lambda p=p, n=node: n is not None and n.revision == p["revision_no"],
            "path_binding": lambda p=p, a=at: a is not None and t.nodes[a].bound_at == tuple(p["bound_at"]),
            "inode_binding": lambda p=p, n=node: n is not None and n.bound_at == tuple(p["bound_at"]),
            "attributes_revision": lambda p=p, n=node: n is not None and n.attributes_no == p["revision_no"],
            "access_revision": lambda p=p, n=node: n is not None and n.access_no == p["revision_no"],
            "path_absence": lambda a=at: a is None,
            "name_absence": lambda p=p: t.child(p["parent_id"], p["name"]) is None,
        }[p["kind"]]
        if not ok():
            raise Refused("precondition_failed", i)


def holding(deltas: DataFrame, head: int, asked: DataFrame, max_depth: int = S.MAX_DEPTH) -> DataFrame:
    """asked with ``holds``: any number of preconditions on the namespace at its head, each as ``check`` decides it. Columns: kind, and
    those that its kind asks for of path, inode_id, revision_no, seq, bound_at (a struct of seq and delta_index), parent_id, name."""
    types = {"path": "string", "inode_id": "bigint", "revision_no": "bigint", "seq": "bigint", "bound_at": "struct<seq:bigint,delta_index:bigint>", "parent_id": "bigint", "name": "string"}
    given = asked.columns
    rows = asked.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in given})
    rows = stored(rows.withColumn("_key", name_key("name")), "asked")
    view = View(deltas, head, max_depth)
    found = view.resolve(rows.where("kind in ('path_binding', 'path_absence')")).select("path", F.col("inode_id").alias("_found"))
    rows = rows.join(found, "path", "left")
    rows = stored(rows.withColumn("_node", F.when(F.col("kind").isin("path_binding", "path_absence"), F.col("_found")).otherwise(F.col("inode_id"))), "asked")

    def of(*kinds: str) -> DataFrame:
        return rows.where(F.col("kind").isin(*kinds)).select(F.col("_node").alias("inode_id")).distinct()

    numbered = ("file_revision", "attributes_revision", "access_revision")
    made = families.inodes(deltas).where(F.col("seq") <= head).select("inode_id").join(of(*numbered), "inode_id", "left_semi").distinct().withColumn("_made", F.lit(True))
    revision = view.revision(of("file_revision")).select("inode_id", F.col("revision_no").alias("_file"))
    attributes = view.attributes(of("attributes_revision")).select("inode_id", F.col("attributes_revision_no").alias("_attributes"))
    access = newest(families.access(deltas).join(of("access_revision"), "inode_id", "left_semi"), ["inode_id"], head).select("inode_id", F.col("access_revision_no").alias("_access"))
    edges = families.bindings(deltas).withColumnRenamed("child_id", "inode_id").join(of("path_binding", "inode_binding"), "inode_id", "left_semi")
    edges = newest(edges, ["inode_id"], head).where("bound").select("inode_id", F.struct("seq", "delta_index").alias("_bound_at"))
    names = rows.where("kind = 'name_absence'").select("parent_id", F.col("_key").alias("name_key")).distinct()
    taken = newest(families.bindings(deltas).join(names, ["parent_id", "name_key"], "left_semi"), ["parent_id", "name_key"], head).where("bound").select("parent_id", F.col("name_key").alias("_key"), F.lit(True).alias("_taken"))
    for more in (made, revision, attributes, access, edges):
        rows = rows.join(more.withColumnRenamed("inode_id", "_node"), "_node", "left")
    rows = rows.join(taken, ["parent_id", "_key"], "left")
    number = lambda c: F.col("_made").isNotNull() & (F.coalesce(c, F.lit(0)) == F.col("revision_no"))
    bound = F.col("_bound_at").isNotNull() & (F.col("_bound_at.seq") == F.col("bound_at.seq")) & (F.col("_bound_at.delta_index") == F.col("bound_at.delta_index"))
    holds = {
        "namespace_head": F.col("seq") == head,
        "file_revision": number("_file"),
        "path_binding": bound,
        "inode_binding": bound,
        "attributes_revision": number("_attributes"),
        "access_revision": number("_access"),
        "path_absence": F.col("_node").isNull(),
        "name_absence": F.col("_taken").isNull(),
    }
    told = F.raise_error(F.concat(F.lit("unknown precondition: "), F.col("kind"))).cast("boolean")
    for kind, v in holds.items():
        told = F.when(F.col("kind") == kind, F.coalesce(v, F.lit(False))).otherwise(told)
    return rows.select(*given, told.alias("holds"))


def plan(t: Tree, operations: list[dict], preconditions: list[dict] = (), committed_by: str = "", committed_at_ms: int = 0) -> list[dict]:
    """Delta rows of one commit at head + 1; the tree moves on only if all operations apply.

    Operations: ``create_directory``, ``put_file`` (path, content_id, replace), ``append_file`` (path, content_id), ``delete`` (path,
    recursive), ``move`` and ``copy`` (path, to, replace), ``restore_deleted`` (inode_id, deletion_seq[, to]), ``restore_revision`` (path,
    revision_no), ``update_attributes`` (path, set, remove), ``update_access`` (path, boundary, grants). Each takes
    inode_id for path where there is an inode.
    """
    if len(operations) > MAX_OPERATIONS:
        raise Refused("too_many_operations")
    check(t, list(preconditions))
    work, seq, rows, group = t.draft(), t.head + 1, [], -1

    def begin() -> None:
        """What follows is an event of its own: parents made on the way, an occupant deleted, attributes copied."""
        nonlocal group
        group += 1

    def emit(k: int, kind: str, inode: int, **more) -> None:
        row = dict.fromkeys(S.DELTA_COLUMNS) | {"seq": seq, "op_index": group, "delta_index": len(rows), "kind": kind, "inode_id": inode, "inode_kind": work.nodes[inode].kind, "committed_by": committed_by, "committed_at_ms": committed_at_ms}
        rows.append(row | more)

    def edge(inode: int) -> dict:
        n = work.nodes[inode]
        return {"parent_id": n.parent, "name_key": fold_name(n.name), "display_name": n.name}

    def bind(k: int, inode: int, parent: int, name: str) -> None:
        work.place(inode, parent, name, (seq, len(rows)))
        emit(k, S.BIND, inode, **edge(inode))

    def unbind(k: int, inode: int) -> None:
        emit(k, S.UNBIND, inode, **edge(inode))
        work.place(inode, None, None)

    def create(k: int, kind: str, parent: int, name: str, content: int | None = None) -> int:
        begin()
        inode = work.next_inode()
        work.nodes[inode] = Node(kind)
        work.made.add(inode)
        emit(k, S.CREATE, inode)
        bind(k, inode, parent, name)
        if kind == "file":
            revise(k, inode, content)
        return inode

    def revise(k: int, inode: int, content: int | None) -> None:
        n = work.own(inode)
        n.revision, n.content = n.revision + 1, content
        n.revisions[n.revision] = content
        emit(k, S.REVISE, inode, revision_no=n.revision, content_id=content)

    def parent_of(k: int, path: str, make: bool) -> tuple[int, str]:
        *up, name = [x for x in path.split("/") if x]
        at = S.ROOT
        for part in up:
            below = work.child(at, part)
            if below is None:
                if not make:
                    raise Refused("parent_not_found", k)
                below = create(k, "directory", at, part)
            if work.nodes[below].kind != "directory":
                raise Refused("not_a_directory", k)
            at = below
        if work.hidden(at):
            raise Refused("parent_not_found", k)
        return at, name

    def target(k: int, op: dict) -> int:
        inode = op["inode_id"] if "inode_id" in op else work.resolve(op["path"])
        if inode is None or inode not in work.nodes or inode == S.ROOT or work.nodes[inode].parent is None or work.hidden(inode):
            raise Refused("not_found", k)
        return inode

    def remove(k: int, inode: int, recursive: bool) -> None:
        if not recursive and work.below.get(inode, 0):
            raise Refused("directory_not_empty", k)
        begin()
        n = work.own(inode)
        told = (seq, n.parent, n.name)
        unbind(k, inode)
        emit(k, S.DELETE, inode)
        n.deleted = told

    def vacate(k: int, op: dict, inode: int | None) -> tuple[int, str]:
        parent, name = parent_of(k, op["to"], False)
        holder = work.child(parent, name)
        if holder is not None and holder != inode:
            if not op.get("replace"):
                raise Refused("already_exists", k)
            remove(k, holder, False)
        return parent, name

    for k, op in enumerate(operations):
        kind = op["kind"]
        if kind in ("create_directory", "put_file"):
            parent, name = parent_of(k, op["path"], True)
            holder = work.child(parent, name)
            if holder is None:
                create(k, "directory" if kind == "create_directory" else "file", parent, name, op.get("content_id"))
            elif kind == "create_directory" or not op.get("replace") or work.nodes[holder].kind != "file":
                raise Refused("already_exists", k)
            else:
                begin()
                revise(k, holder, op["content_id"])
        elif kind == "append_file":
            inode = target(k, op)
            if work.nodes[inode].kind != "file":
                raise Refused("not_a_file", k)
            begin()
            revise(k, inode, op["content_id"])
        elif kind == "delete":
            remove(k, target(k, op), op.get("recursive", False))
        elif kind == "move":
            inode = target(k, op)
            parent, name = vacate(k, op, inode)
            if inode == parent or inode in work.above(parent):
                raise Refused("would_create_cycle", k)
            begin()
            unbind(k, inode)
            bind(k, inode, parent, name)
        elif kind == "copy":
            inode = target(k, op)
            if work.nodes[inode].kind != "file":
                raise Refused("not_a_file", k)
            parent, name = parent_of(k, op["to"], False)
            holder, source = work.child(parent, name), work.nodes[inode]
            if holder is None:
                made = create(k, "file", parent, name, source.content)
                if source.attributes:
                    work.own(made).attributes, work.own(made).attributes_no = dict(source.attributes), 1
                    begin()
                    emit(k, S.ATTRIBUTES, made, attributes_revision_no=1, attributes=dict(source.attributes))
            elif op.get("replace") and work.nodes[holder].kind == "file":
                begin()
                revise(k, holder, source.content)
            else:
                raise Refused("already_exists", k)
        elif kind == "restore_deleted":
            n = work.nodes.get(op["inode_id"])
            if n is None or not n.deleted or n.deleted[0] != op["deletion_seq"]:
                raise Refused("not_in_trash", k)
            parent, name = parent_of(k, op["to"], False) if "to" in op else n.deleted[1:]
            if work.child(parent, name) is not None:
                raise Refused("already_exists", k)
            if work.hidden(parent):
                raise Refused("parent_not_found", k)
            begin()
            emit(k, S.REVOKE, op["inode_id"], target_seq=n.deleted[0])
            work.own(op["inode_id"]).deleted = None
            bind(k, op["inode_id"], parent, name)
        elif kind == "restore_revision":
            inode = target(k, op)
            if op["revision_no"] not in work.nodes[inode].revisions:
                raise Refused("revision_not_found", k)
            begin()
            revise(k, inode, work.nodes[inode].revisions[op["revision_no"]])
        elif kind == "update_attributes":
            n = work.own(inode := target(k, op))
            n.attributes = {a: b for a, b in (n.attributes | op.get("set", {})).items() if a not in op.get("remove", ())}
            n.attributes_no += 1
            begin()
            emit(k, S.ATTRIBUTES, inode, attributes_revision_no=n.attributes_no, attributes=dict(n.attributes))
        elif kind == "update_access":
            n = work.own(inode := target(k, op))
            n.access_no += 1
            begin()
            emit(k, S.ACCESS, inode, access_revision_no=n.access_no, boundary=op.get("boundary", False), grants=dict(op.get("grants", {})))
        else:
            raise Refused("unknown_operation", k)
    t.nodes, t.names, t.below, t.head = work.nodes, work.names, work.below, seq
    t.made, t.free, t._last = work.made, work.free, work._last
    return rows
