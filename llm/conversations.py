"""Conversation repair: the cheapest edits that give a conversation alternating roles.

The rows of a conversation, in order of turn, are edited one by one: Keep costs nothing, Rerole to user or assistant 2,
Delete 3 (and is the only edit of a blank or duplicate row), and a row with empty text can be Inserted anywhere for 2; a
truncated row that stays costs 1 more. What is left must read ``(s?(ua)+)?`` in role initials. The audit is the
string of the edits' initials; of equally cheap audits the ASCII-least counts.

The edits are found by dynamic programming over four states (nothing, s, u, a), forward and in a stream, so no
conversation is ever held. The audit of each state is a node of a tree that all states share: it knows its
parent, one ancestor further up (at the skew-binary distances of a binary lifting table) and the rolling hash of its letters.
Equally cheap audits are compared by their longest common prefix, found on these ancestors by hash; that the two
ancestors found are one node is verified, and if they are not (a collision of hashes) the letters are compared. A prefix
that all states agree on is cut off and kept as plain letters. The digest of each state's repaired text is carried
along the same way, so texts are read once.

Equal costs never tie by length: after the same rows, of two audits of equal cost none is the beginning of the other, since
the longer one would have inserted more. So the least prefix always is the beginning of the least audit.

Null roles and texts count as one space, null turns come first. Rows of one turn are ordered by role, then text. A
conversation of which no row is left has an empty audit. Repeated rows are duplicates (the later ones); an
empty table gives no rows; a null ``conv_id`` is a conversation of its own; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import read

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NO_FAULT, BLANK, DUPLICATE, CUT = range(4)
#: Rows after which the prefix that all states share is looked for.
SETTLE = 4096
_BASE, _MOD = 0x5DEECE66D, (1 << 61) - 1
START, SYSTEM, USER, ASSISTANT = range(4)
#: Role initial -> (states before, state after).
_STEPS = {"s": ((START,), SYSTEM), "u": ((START, SYSTEM, ASSISTANT), USER), "a": ((USER,), ASSISTANT)}
_NAMES = {USER: "user", ASSISTANT: "assistant"}


# --- audits as shared nodes


class Node:
    """An audit: its last letter, the audit before it, and an ancestor further up."""

    __slots__ = ("parent", "jump", "depth", "letter", "hash")

    def __init__(self, parent: Node | None, letter: str, depth: int = 0, hash_: int = 0):
        self.parent, self.letter = parent, letter
        if parent is None:
            self.jump, self.depth, self.hash = self, depth, hash_
        else:
            j = parent.jump
            self.jump = j.jump if parent.depth - j.depth == j.depth - j.jump.depth else parent
            self.depth = parent.depth + 1
            self.hash = (parent.hash * _BASE + ord(letter)) % _MOD


def lifted(node: Node, depth: int) -> Node:
    while node.depth > depth:
        node = node.jump if node.jump.depth >= depth else node.parent
    return node


def letters(node: Node, above: int = 0) -> str:
    """The letters of a node below the given depth."""
    out = []
    while node.parent is not None and node.depth > above:
        out.append(node.letter)
        node = node.parent
    return "".join(reversed(out))


def less(a: Node, b: Node) -> bool:
    """Whether the audit of ``a`` comes before that of ``b`` in ASCII order."""
    depth = min(a.depth, b.depth)
    x, y = lifted(a, depth), lifted(b, depth)
    while x.hash != y.hash:
        x, y = (x.jump, y.jump) if x.jump.hash != y.jump.hash else (x.parent, y.parent)
    if x is not y:  # equal hashes of two prefixes: not one node, so the letters decide
        return letters(a) < letters(b)
    if x.depth == depth:
        return a.depth < b.depth
    return lifted(a, x.depth + 1).letter < lifted(b, x.depth + 1).letter


# --- one conversation


class Repair:
    """The state of one conversation while its rows stream by; ``report`` ends it."""

    def __init__(self):
        root = Node(None, "")
        #: For each state: (cost, audit, digest of the repaired text, rows in it), or None.
        self.best: list[tuple | None] = [(0, root, hashlib.sha256(), 0), None, None, None]
        self.settled: list[str] = []
        self.root = root
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.initial = None
        self._insert()

    def row(self, turn: int | None, role: str, text: str, fault: int) -> None:
        initial = role[:1]
        self.illegal += self.rows > 0 and f"{self.initial}{initial}" not in ("su", "ua", "au")
        self.initial = initial
        self.rows += 1
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.blank += fault == BLANK
        self.duplicate += fault == DUPLICATE
        self.truncated += fault == CUT
        self._edit(role, text, fault)
        self._insert()
        if self.rows % SETTLE == 0:
            self._settle()

    def _edit(self, role: str, text: str, fault: int) -> None:
        choices: list[list[tuple]] = [[(b[0] + DELETE, b, "D", None)] if b else [] for b in self.best]
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED if fault == CUT else 0
            before, after = _STEPS.get(role[:1], ((), 0))
            choices[after] += [(b[0] + KEEP + more, b, "K", role) for b in map(self.best.__getitem__, before) if b]
            for state in (USER, ASSISTANT):
                choices[state] += [(b[0] + REROLE + more, b, "R", _NAMES[state]) for b in map(self.best.__getitem__, _STEPS[_NAMES[state][0]][0]) if b]
        self.best = [self._won(c, text) for c in choices]

    def _insert(self) -> None:
        """Rows put in after what is there: a user one, then an assistant one after it; more never pays."""
        for state in (USER, ASSISTANT):
            own = self.best[state]
            new = [(b[0] + INSERT, b, "I", _NAMES[state]) for b in map(self.best.__getitem__, _STEPS[_NAMES[state][0]][0]) if b]
            least = min(new, default=None, key=lambda c: c[0])
            if least and (own is None or least[0] <= own[0]):
                self.best[state] = self._won(new, "", own)

    @staticmethod
    def _won(choices: list[tuple], text: str, own: tuple | None = None) -> tuple | None:
        """The cheapest choice, the least audit among equals, with its row written to its digest."""
        if not choices:
            return own
        cost = min(c[0] for c in choices)
        (best, node), *rest = [(c, Node(c[1][1], c[2])) for c in choices if c[0] == cost]
        for c, n in rest:
            if less(n, node):
                best, node = c, n
        if own is not None and (own[0] < cost or own[0] == cost and less(own[1], node)):
            return own
        _, (_, _, digest, many), _, role = best
        if role is not None:
            digest = digest.copy()
            digest.update(f"{chr(10) if many else ''}{role}:".encode())
            digest.update(text.encode())
            many += 1
        return cost, node, digest, many

    def _settle(self) -> None:
        """Keep the prefix that all states share as letters, and let its nodes go."""
        live = [b[1] for b in self.best if b]
        x = live[0]
        for y in live[1:]:
            depth = min(x.depth, y.depth)
            x, y = lifted(x, depth), lifted(y, depth)
            while x is not y:
                x, y = (x.jump, y.jump) if x.jump is not y.jump else (x.parent, y.parent)
        if x.depth == self.root.depth:
            return
        self.settled.append(letters(x, self.root.depth))
        made = {id(x): Node(None, "", x.depth, x.hash)}
        for n in live:
            path = []
            while id(n) not in made:
                path.append(n)
                n = n.parent
            for n in reversed(path):
                made[id(n)] = Node(made[id(n.parent)], n.letter)
        self.root = made[id(x)]
        self.best = [(b[0], made[id(b[1])], *b[2:]) if b else None for b in self.best]

    def report(self) -> tuple:
        """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest)"""
        start, end = self.best[START], self.best[ASSISTANT]
        last = end if start is None or end is not None and (end[0] < start[0] or end[0] == start[0] and less(end[1], start[1])) else start
        gaps = self.high - self.low + 1 - self.turns if self.low is not None else 0
        audit = "".join([*self.settled, letters(last[1])]) if self.rows else ""
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, last[0], audit, last[2].hexdigest()


# --- conversations


def _order() -> list[Column]:
    """By turn; of equal rows the one that is no duplicate is first."""
    return [F.asc_nulls_first("turn"), F.col("role").asc(), F.col("text").asc(), (F.col("fault") == DUPLICATE).asc()]


def ordered(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) without nulls in role and text, with the first ``fault`` of each."""
    d = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    trimmed = F.rtrim("text", F.lit(SPACES))
    # texts are told apart by a digest, so that the window's keys are short
    again = Window.partitionBy("conv_id", "role", F.sha2("text", 256)).orderBy(F.asc_nulls_first("turn"))
    fault = F.when(trimmed == "", BLANK).when(F.row_number().over(again) > 1, DUPLICATE).when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(NO_FAULT)
    return d.withColumn("fault", fault)


def _reports(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    now, key, out = None, None, []

    def flush() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
        out.clear()
        return b

    for b in batches:
        for conv, there, turn, role, text, fault in zip(*[b.column(c).to_pylist() for c in ("conv_id", "there", "turn", "role", "text", "fault")]):
            if now is None or conv != key:
                if now is not None:
                    out.append((key, *now.report()))
                now, key = Repair(), conv
            if there:
                now.row(turn, role, text, fault)
        if out:
            yield flush()
    if now is not None:
        out.append((key, *now.report()))
        yield flush()


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row a conversation of ``rows`` (conv_id, turn, role, text): its faults, the cost and the audit of its repair, and the digest of the
    repaired ``role:text`` lines. ``conversations`` (conv_id) adds conversations of which no row may be left.

    One exchange and sort by conversation; a conversation streams through one task, which holds its unsettled audit
    nodes and never its texts."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    d = ordered(rows).withColumn("there", F.lit(True))
    if conversations is not None:
        d = d.unionByName(conversations.select("conv_id").distinct().withColumn("there", F.lit(False)), allowMissingColumns=True)
    d = d.repartition("conv_id").sortWithinPartitions("conv_id", *_order())
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = pa.schema([("conv_id", pa.int64() if kind != "string" else pa.string()), *[(c, pa.int64()) for c in counts], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    cast = d.withColumn("conv_id", F.col("conv_id").cast("long" if kind != "string" else "string"))
    text = f"conv_id {'string' if kind == 'string' else 'long'}, " + ", ".join(f"{c} long" for c in counts) + ", audit string, repaired_sha256 string"
    return cast.mapInArrow(lambda it: _reports(it, schema), text)


def repaired(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """(conv_id, position, role, text) of the repaired conversations: what `repair`'s audits make of ``rows``, as joins and windows."""
    own = Window.partitionBy("conv_id").orderBy(*_order())
    d = ordered(rows).withColumn("k", F.row_number().over(own)).select("conv_id", "k", "role", "text")
    edits = reports.where("audit <> ''").select("conv_id", F.posexplode(F.split("audit", "")).alias("at", "edit")).where("edit <> ''")
    so_far = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    e = edits.withColumn("k", F.when(F.col("edit") != "I", F.sum(F.when(F.col("edit") != "I", 1).otherwise(0)).over(so_far))).where("edit <> 'D'")
    e = e.withColumn("position", F.row_number().over(Window.partitionBy("conv_id").orderBy("at")))
    left = F.count(F.lit(1)).over(Window.partitionBy("conv_id")) - F.col("position")
    e = e.withColumn("new", F.when(left % 2 == 0, "assistant").otherwise("user"))
    same = e["conv_id"].eqNullSafe(d["conv_id"]) & (e["k"] == d["k"])
    return e.join(d, same, "left").select(e["conv_id"], "position", F.when(F.col("edit") == "K", d["role"]).otherwise(F.col("new")).alias("role"), F.coalesce(d["text"], F.lit("")).alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with known faults, by the CRC of ``conv_id:turn``: one in twenty rows each is dropped, emptied,
    left without ``.!?``, repeated, or made a user's. Nulls count as one space."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = rows.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"), (F.crc32(F.concat_ws(":", or_space("conv_id"), or_space("turn"))) % 20).alias("how"))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    d = d.withColumns({"text": text, "role": F.when(F.col("how") == 4, "user").otherwise(F.col("role"))}).where("how <> 0")
    copies: Column = F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return d.select("conv_id", "turn", "role", "text", copies.alias("copy")).drop("copy")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair(damaged(rows), rows)
