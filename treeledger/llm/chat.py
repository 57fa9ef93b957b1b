"""Chat formatting with spans found by incremental black-box rendering.

A template is a function from a list of turns to text. Turns are rendered as successive prefixes; where one output begins
with the one before it, what it adds is the span of the new turn. Where it doesn't, the template has rewritten history:
the conversation is marked from there on and the spans can't be trusted. The words of an assistant's turn are found
within its span by rendering the prefix again with a sentinel for the turn's text; they are the loss mask.

Any template is rendered on whole prefixes, so that a rewrite of any earlier turn is seen; one task then renders a
conversation, and its cost grows with the square of the turns. A template may state its ``context``: no more than so many
turns before a turn bear on what it adds. Then rows are dealt by conversation and stretch of turns; a stretch also gets the
last ``context`` turns of the one before it, and prefixes go on from these. The prefix drops its oldest turns when it has twice ``context``;
its last turns are then rendered anew, prefix by prefix, and must add what they added before. So outputs are compared
across stretches and drops too, and a statement that is false shows as a rewrite.

The own template (context 4) writes ``### role: text </turn>`` and a newline. Backslashes, number signs, less-than signs
and (in roles) colons of the content get a backslash before them, so control strings cannot occur in it, and dropping
those backslashes gives it back.

Defined cases: null text or role is empty; null turns come first; rows of one turn are ordered by role and text; repeated
rows are turns each; null conv_id is a conversation of its own; where turn numbers leave out a whole stretch's end, a
template with a context starts anew after the gap; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Turn numbers of one stretch, and turns of one chunk of output.
STRETCH, CHUNK = 64, 64
_SENTINEL = "qz0sentinel0zq"
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*) </turn>\n", re.S)
TRAINED = frozenset({"assistant"})


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("<", "\\<")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def turn_template(turns: list[Turn]) -> str:
    return "".join(f"### {escape(role).replace(':', chr(92) + ':')}: {escape(text)} </turn>\n" for role, text in turns)


turn_template.context = 4


def parse(formatted: str) -> list[Turn]:
    """The turns of the own template's output."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


class Renderer:
    """Successive prefixes of one conversation, or of a stretch of it after some turns of context."""

    def __init__(self, template: Template, context: int | None, trained: frozenset[str] = TRAINED) -> None:
        self.template, self.context, self.trained = template, context, trained
        self.turns: list[Turn] = []
        self.output, self.added, self.rewritten = "", [], False
        """Output of the prefix, and what each of its turns added."""

    def push(self, turn: Turn) -> tuple[int, str, tuple[int, int] | None]:
        """Renders one more turn: where in the last output it begins, what there is from there on, and its loss mask in that."""
        if self.context is not None and len(self.turns) >= 2 * max(1, self.context):
            self._drop()
        now = self.template([*self.turns, turn])
        start = self._begin(self.output, now)
        mask = None
        if turn[0] in self.trained:
            probe = self.template([*self.turns, (turn[0], _SENTINEL)])
            at = probe.find(_SENTINEL, min(start, len(probe)))
            if at >= 0:
                mask = (at - start, len(now) - (len(probe) - at - len(_SENTINEL)) - start)
        self.turns.append(turn)
        self.output = now
        self.added.append(now[start:])
        return start, now[start:], mask

    def _begin(self, before: str, now: str) -> int:
        if now.startswith(before):
            return len(before)
        self.rewritten = True
        return next((i for i, (a, b) in enumerate(zip(before, now, strict=False)) if a != b), min(len(before), len(now)))

    def _drop(self) -> None:
        """The prefix goes on from its last ``context`` turns, which must add in the shorter prefix what they added in the longer."""
        self.turns, old = self.turns[len(self.turns) - self.context :], self.added[len(self.added) - self.context :]
        self.output, self.added = "", []
        for k in range(len(self.turns)):
            now = self.template(self.turns[: k + 1])
            start = self._begin(self.output, now)
            self.added.append(now[start:])
            self.rewritten |= k > 0 and now[start:] != old[k]  # the first also has what stands before all turns
            self.output = now


def located(turns: list[Turn], template: Template, trained_roles: frozenset[str] = TRAINED) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]], bool]:
    """Output for the turns, span of each turn, spans of the loss mask, and whether history was rewritten."""
    r, spans, mask = Renderer(template, None, trained_roles), [], []
    for turn in turns:
        start, _, m = r.push(turn)
        spans.append((start, len(r.output)))
        if m:
            mask.append((start + m[0], start + m[1]))
    return r.output, spans, mask, r.rewritten


_CHUNK = "conv_id long, stretch long, chunk long, formatted string, spans array<struct<start:int,end:int>>, mask array<struct<start:int,end:int>>, rewritten boolean"


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def formatted(conversations: DataFrame, template: Template = turn_template) -> DataFrame:
    """Chunks of formatted text with the spans in them; conv_id, stretch, chunk give their order. Of a template that rewrites
    history the last chunk has the whole output where it states no context; else a chunk has what its turns added."""
    out, context = _arrow(_CHUNK), getattr(template, "context", None)
    told = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    if context is None:
        rows = told.select("conv_id", F.lit(0).cast("long").alias("stretch"), F.lit(True).alias("own"), "turn", "role", "text")
    else:
        own = F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-(1 << 62))).cast("long")
        # the last turns of a stretch are context of the next one
        ahead = F.col("turn").isNotNull() & (F.pmod("turn", F.lit(STRETCH)) >= STRETCH - context)
        into = F.when(ahead, F.array(F.struct(own.alias("stretch"), F.lit(True).alias("own")), F.struct((own + 1).alias("stretch"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(own.alias("stretch"), F.lit(True).alias("own"))))
        rows = told.select("conv_id", F.explode(into).alias("into"), "turn", "role", "text").select("conv_id", "into.stretch", "into.own", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, renderer, chunk = None, None, 0
        pieces, spans, mask, size = [], [], [], 0

        def close(last: bool) -> list[dict]:
            nonlocal pieces, spans, mask, size, chunk
            if not pieces:
                return []
            pair = lambda xs: [{"start": a, "end": b} for a, b in xs]
            text = renderer.output if context is None and renderer.rewritten and last else "".join(pieces)
            row = {"conv_id": key[0], "stretch": key[1], "chunk": chunk, "formatted": text, "spans": pair(spans), "mask": pair(mask), "rewritten": renderer.rewritten}
            pieces, spans, mask, size, chunk = [], [], [], 0, chunk + 1
            return [row]

        for batch in batches:
            got = []
            for conv, stretch, own, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5)), strict=True):
                if renderer is None or key != (conv, stretch):
                    got += close(True)
                    key, renderer, chunk = (conv, stretch), Renderer(template, context), 0
                _, added, m = renderer.push((role, text))
                if own:
                    pieces.append(added)
                    spans.append((size, size + len(added)))
                    if m:
                        mask.append((size + m[0], size + m[1]))
                    size += len(added)
                    if len(spans) == CHUNK:
                        got += close(False)
            yield pa.RecordBatch.from_pylist(got, schema=out)
        yield pa.RecordBatch.from_pylist(close(True), schema=out)

    return rows.repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "turn", "role", "text").mapInArrow(run, _CHUNK)


def digests(chunks: DataFrame) -> DataFrame:
    """Per conversation, from the formatted text and its mask alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    out = _arrow(schema)

    def run(batches):
        key, begun, n, chars, size = None, False, 0, 0, 0
        turns, loss = hashlib.sha256(), hashlib.sha256()
        row = lambda: dict(zip(out.names, (key, n, turns.hexdigest(), chars, loss.hexdigest(), size), strict=True))
        for batch in batches:
            got = []
            for conv, text, mask in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4)), strict=True):
                if not begun or conv != key:
                    if begun:
                        got.append(row())
                    key, begun, n, chars, size = conv, True, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                for role, said in parse(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for m in mask:
                    said = unescape(text[m["start"] : m["end"]])
                    chars += len(said)
                    loss.update(said.encode())
                size += len(text)
            yield pa.RecordBatch.from_pylist(got, schema=out)
        if begun:
            yield pa.RecordBatch.from_pylist([row()], schema=out)

    return chunks.select("conv_id", "stretch", "chunk", "formatted", "mask").repartition("conv_id").sortWithinPartitions("conv_id", "stretch", "chunk").mapInArrow(run, schema)
