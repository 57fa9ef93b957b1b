"""URL rules by a sort-merge range join.

A host's canonical key is its labels reversed, each with a dot after it (``www.example.net`` -> ``net.example.www.``), so
a rule on a host covers exactly the keys of one interval: those that begin with its own key. Rows and rules are cut into
parts at quantiles of the rows' keys; a rule goes to every part its interval meets, and a key that fills several parts is
dealt over them evenly. Each part, in order of key, is swept once: a stack holds the rules whose intervals contain
the sweep's position, nested.

The paths of a rule host on the stack lie in a table of at most ``MAX_PATHS``. A host with more rules is only marked in
that sweep. A row below it goes on, once for every such host, to a second sweep of the same kind, whose keys are host and
path and whose stack holds single rules. So a task holds the rules of the labels above one position, never a whole list,
and no rule list is broadcast.

A rule fits its host and all subdomains where the url's path begins with the rule's. Of fitting rules the longest (host
plus path) wins, at a tie the one with the longer host; if a host and path is listed twice, block wins. Without a rule the
verdict is ``default``.

Defined cases: null url, or one without ``://``: empty host and path; repeated rows are judged each; a rule's host is
compared without regard to the case of A-Z and told as it was written; a rule's null path is empty; a rule with a null or
empty host, or a null verdict, says nothing; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

#: Sampled keys per part, which place the cuts, and characters of a key used for that.
SAMPLE_PER_PART, KEY_CHARS = 32, 256
#: Rules of one host that a sweep holds as a table.
MAX_PATHS = 1 << 16
RULE, ROW = 0, 1
_JUDGED = "page_id long, host string, path string, rule string, verdict string, n int, n_host int, heavy array<string>"


def lowered(text) -> F.Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host, path, key."""
    at = F.coalesce(F.instr("url", "://"), F.lit(0))
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rows = pages.select("page_id", rest.alias("rest")).select("page_id", lowered(F.regexp_extract("rest", r"^[^/?#]*", 0)).alias("host"), F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))
    return rows.withColumn("key", reversed_host(F.col("host")))


def reversed_host(host) -> F.Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _cuts(keys: DataFrame, parts: int) -> list[str]:
    """Keys between the parts. About SAMPLE_PER_PART keys a part come to the driver, however many rows there are."""
    share = min(1.0, SAMPLE_PER_PART * parts / max(1, keys.count()))
    sample = sorted(r[0] for r in keys.select(F.substring("key", 1, KEY_CHARS)).sample(False, share, 1).collect())
    return [sample[len(sample) * i // parts] for i in range(1, parts)] if sample else []


def swept(rows: DataFrame, rules: DataFrame, fields: list[str], judge: Callable, out: str) -> DataFrame:
    """The sort-merge join of rows (key, fields) with rules (key, host, path, verdict) whose key begins the row's key.

    ``judge`` is made anew for a task; it has ``move`` (to a part and key), ``add`` (a rule at the present key) and ``row`` (of the
    row's fields, giving the columns of ``out``).
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _cuts(rows, parts)
    types = dict(rows.dtypes)
    schema = f"part int, key string, kind int, verdict string, {', '.join(f'{f} {types[f]}' for f in fields)}"
    arrow, told = _arrow(schema), _arrow(out)
    place = [fields.index(f) for f in ("host", "path")]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, part = b.column(0).to_pylist(), []
            for k, digest in zip(keys, b.column(1).to_pylist(), strict=True):
                lo, hi = bisect.bisect_left(cuts, k), bisect.bisect_right(cuts, k)
                part.append(lo + (digest % (hi - lo + 1) if hi > lo else 0))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), b.column(0), pa.array([ROW] * len(part), pa.int32()), pa.nulls(len(part), pa.string()), *(c.cast(f.type) for c, f in zip(b.columns[2:], list(arrow)[4:], strict=True))], schema=arrow)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for key, host, path, verdict in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lo, hi = bisect.bisect_left(cuts, key), bisect.bisect_right(cuts, key, key=lambda c, n=len(key): c[:n])
                got += [{"part": p, "key": key, "kind": RULE, "verdict": verdict, "host": host, "path": path} for p in range(lo, hi + 1)]
            yield pa.RecordBatch.from_pylist(got, schema=arrow)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = judge()
        for b in batches:
            got = []
            for part, key, kind, verdict, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                state.move(part, key)
                if kind == RULE:
                    state.add(key, rest[place[0]], rest[place[1]], verdict)
                else:
                    got.append(state.row(rest))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True) if got else [[]] * len(told), told, strict=True)], schema=told)

    digest = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30))  # any of a key's parts will do
    both = rows.select("key", digest.alias("digest"), *fields).mapInArrow(deal, schema).unionByName(rules.select("key", "host", "path", "verdict").mapInArrow(spread, schema))
    return both.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "key", "kind").mapInArrow(sweep, out)


class _Stack:
    """Entries around the present key, innermost last: [key, what is held there]."""

    def __init__(self) -> None:
        self.part, self.stack = None, []

    def move(self, part: int, key: str) -> None:
        if part != self.part:
            self.part, self.stack = part, []
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def top(self, key: str, new: Callable):
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, new()))
        return self.stack[-1][1]


class HostSweep(_Stack):
    """Rules by host, the paths of each in a table by length; a marked host (path null) is told to the row."""

    def add(self, key: str, host: str, path: str | None, verdict: str) -> None:
        held = self.top(key, dict)
        if path is None:
            held[None] = True
        else:
            by_path = held.setdefault(len(path), {})
            if verdict == "block" or path not in by_path:
                by_path[path] = (host, verdict)

    def row(self, rest: list) -> tuple:
        page_id, host, path = rest
        best, heavy = (-1, -1, None, None), []
        for key, held in self.stack:
            if None in held:
                heavy.append(key)
            for n in sorted((x for x in held if x is not None), reverse=True):
                if n <= len(path) and (hit := held[n].get(path[:n])):
                    if (len(key) + n, len(key)) > best[:2]:
                        best = (len(key) + n, len(key), hit[0] + path[:n], hit[1])
                    break
        return page_id, host, path, best[2], best[3], best[0], best[1], heavy or None


class PathSweep(_Stack):
    """Rules of heavy hosts; the innermost entry is the longest rule of the row's host and path."""

    def add(self, key: str, host: str, path: str, verdict: str) -> None:
        held = self.top(key, list)
        if not held or verdict == "block":
            held[:] = [host + path, verdict]

    def row(self, rest: list) -> tuple:
        uid, n_host, _, path = rest
        if not self.stack:
            return uid, None, None, -1, -1
        key, held = self.stack[-1]
        return uid, held[0], held[1], n_host + len(key.split("\x00", 1)[1]), n_host


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow", max_paths: int = MAX_PATHS) -> DataFrame:
    """page_id, host, path, rule, verdict of every page. rules: host, path, verdict."""
    told = rules.where("host <> '' and verdict is not null").select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict", reversed_host(lowered(F.col("host"))).alias("key"))
    heavy = told.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > max_paths).select("key")
    any_heavy = not heavy.isEmpty()
    light = told.join(heavy, "key", "left_anti").unionByName(heavy.select(F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("verdict"), "key")) if any_heavy else told
    out = swept(parsed(pages), light, ["page_id", "host", "path"], HostSweep, _JUDGED)
    if any_heavy:
        out = written(out, "urls").withColumn("uid", F.monotonically_increasing_id())  # fixed, as the files are
        asked = out.where("heavy is not null").select("uid", "path", F.explode("heavy").alias("host"))
        asked = asked.select("uid", F.length("host").alias("n_host"), "host", "path", F.concat_ws("\x00", "host", "path").alias("key"))
        deep = told.join(heavy, "key", "left_semi").withColumn("key", F.concat_ws("\x00", "key", "path"))
        more = swept(asked, deep, ["uid", "n_host", "host", "path"], PathSweep, "uid long, rule2 string, verdict2 string, n2 int, n_host2 int")
        best = more.where("n2 >= 0").groupBy("uid").agg(F.max(F.struct("n2", "n_host2", "rule2", "verdict2")).alias("b"))
        out = out.join(best, "uid", "left")
        wins = F.col("b").isNotNull() & ((F.col("b.n2") > F.col("n")) | ((F.col("b.n2") == F.col("n")) & (F.col("b.n_host2") > F.col("n_host"))))
        out = out.withColumn("rule", F.when(wins, F.col("b.rule2")).otherwise(F.col("rule"))).withColumn("verdict", F.when(wins, F.col("b.verdict2")).otherwise(F.col("verdict")))
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
