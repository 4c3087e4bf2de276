"""Conversation structure repair with a generalised LR parser over the role grammar.

The grammar of a conversation's role initials is ``(s?(ua)+)?``. Rows are read from the last to the first, so that the
audit grows at its front and merging stacks with equal tops by the smaller (cost, audit) is exact: the same edit before two
audits never changes their order. (Read forwards, an audit that is the beginning of another could lose the comparison
later.) A stack top is what stands before the rows read so far: nothing, ``s``, ``u`` or ``a``. Per row the
graph-structured stack gets one layer of at most four nodes, each with the edit that leads on from it; audits are
compared by their first letter and the rank of the node they go on with, so a row costs the same at any length.

Rows are folded (equal rows keep a count), dealt and sorted by ranges of (conversation, turn, role, text), so a long
conversation spreads over tasks. A task parses its piece once for every top that may follow; the pieces of conversations at
the edges of a range (two a range at most) meet with their tables of audits and are joined in their order. SHA-256 reads
its input in order, so the repaired rows of such a conversation are hashed by one task, which streams them in bounded memory.

Nulls: one space, in every column; rows with null conv_id are one conversation, with a null conv_id in the result. Ties of a
turn are ordered by role and text; nulls of a turn come first. Empty roles have no initial and are never kept. Empty texts
are blank. Repeated rows are duplicates. Very long texts are hashed whole. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, shuffle_partitions, staged

#: Stack tops: nothing, s, u or a stands before. The top after a kept initial, and after the row that a top asks for.
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
SHIFT = {(NOTHING, "s"): AFTER_S, (NOTHING, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
ASKS = {NOTHING: ("user", AFTER_U), AFTER_S: ("user", AFTER_U), AFTER_U: ("assistant", AFTER_A), AFTER_A: ("user", AFTER_U)}
ACCEPTING = (NOTHING, AFTER_A)
LEGAL = ("su", "ua", "au")
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
WHITE = " \t\n\x0b\x0c\r"


class Stack:
    """The graph-structured stack: a layer per row read, of nodes top -> (cost, edit, times, layer it goes on in, top there, rank)."""

    def __init__(self, tops: Iterable[int], closed: bool) -> None:
        """``tops`` may stand at the end; ``closed``: rows may be inserted there."""
        self.layers: list[dict[int, tuple]] = []
        self._push({top: (0, "", 0, 0, top) for top in tops}, closed)

    def _push(self, found: dict[int, tuple], closed: bool) -> None:
        """A new layer, after insertions before it if ``closed`` and with the ranks of its audits."""
        at = len(self.layers)
        before = {top: (node[1], self.layers[node[3]][node[4]][5] if node[1] else 0) for top, node in found.items()}

        def inserted(top: int) -> None:
            on = ASKS[top][1]
            if on in found and (top not in found or (found[on][0] + INSERT, ("I", *before[on])) < (found[top][0], before[top])):
                better[top] = ((found[on][0] + INSERT, "I", 1, at, on), ("I", *before[on]))

        if closed:
            # u and a lead to each other, nothing and s to u only
            for pair in ((AFTER_U, AFTER_A), (NOTHING, AFTER_S)):
                better: dict[int, tuple] = {}
                for top in pair:
                    inserted(top)
                for top, (node, key) in better.items():
                    found[top], before[top] = node, key
        order = sorted(set(before.values()))
        self.layers.append({top: (*node, order.index(before[top])) for top, node in found.items()})

    def read(self, initial: str, forced: bool, truncated: bool, repeats: int) -> None:
        """A row, which is followed by ``repeats`` equal ones: duplicates, to be deleted."""
        if repeats or forced:
            # deleting sorts before inserting, and the layer below is closed: no insertion helps here
            times = repeats + forced
            self._push({top: (node[0] + DELETE * times, "D", times, len(self.layers) - 1, top) for top, node in self.layers[-1].items()}, False)
        if forced:
            return
        at, below, extra, found = len(self.layers) - 1, self.layers[-1], TRUNCATED * truncated, {}
        for top in range(4):
            options = [(DELETE, "D", top), (extra, "K", SHIFT.get((top, initial))), (REROLE + extra, "R", ASKS[top][1])]
            options = [(below[on][0] + cost, letter, below[on][5], on) for cost, letter, on in options if on in below]
            if options:
                cost, letter, _, on = min(options)
                found[top] = (cost, letter, 1, at, on)
        self._push(found, True)

    def best(self, top: int = NOTHING) -> tuple[int, str]:
        """Cost and audit of the rows read, from ``top``."""
        cost, at, letters = self.layers[-1][top][0], len(self.layers) - 1, []
        while True:
            _, letter, times, below, on, _ = self.layers[at][top]
            if not letter:
                return cost, "".join(letters)
            letters.append(letter * times)
            at, top = below, on


def parsed(rows: list[tuple], tops: Iterable[int] = ACCEPTING, closed: bool = True) -> Stack:
    """The stack over rows of (initial, forced, truncated, repeats) in their order."""
    stack = Stack(tops, closed)
    for row in reversed(rows):
        stack.read(*row)
    return stack


def repaired(audit: str, rows: Iterable[tuple[str, str, int]]) -> Iterator[str]:
    """The lines role:text of a repaired conversation; ``rows`` of (role, text, repeats) are read once, in their order."""
    rows, left, top, role, text = iter(rows), 0, NOTHING, "", ""
    for letter in audit:
        if letter != "I":
            if not left:
                role, text, left = next(rows)
                left += 1
            left -= 1
        if letter == "K":
            yield f"{role}:{text}"
            top = SHIFT[top, role[:1]]
        elif letter != "D":
            asked, top = ASKS[top]
            yield f"{asked}:{text if letter == 'R' else ''}"


def digest_of(lines: Iterable[str]) -> str:
    digest = hashlib.sha256()
    for i, line in enumerate(lines):
        digest.update((f"\n{line}" if i else line).encode())
    return digest.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: the rows after damage; role and text are never null."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    crc = F.crc32(F.encode(F.concat(said("conv_id"), F.lit(":"), said("turn")), "UTF-8"))
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), F.pmod(crc, F.lit(20)).alias("fate"))
    fate = F.col("fate")
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(fate == 4, "user").otherwise(F.col("role"))
    return rows.where(fate != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(fate == 3, 2).otherwise(1).cast("long").alias("copies"))


def with_faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies, blank, duplicate, truncated: equal rows folded, with the first fault of their first."""
    folded = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    folded = staged(folded.withColumn("said", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    # nulls of a turn come first
    seen = folded.groupBy("conv_id", "said").agg(F.count("*").alias("turns"), F.count_if(F.col("turn").isNull()).alias("unknown"), F.min("turn").alias("first")).where("turns > 1")
    seen = seen.select(F.col("conv_id").alias("of"), F.col("said").alias("what"), "unknown", "first")
    both = folded.join(seen, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("said") == F.col("what")), "left")
    later = F.when(F.col("what").isNull(), False).when(F.col("unknown") > 0, F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first"))
    bare = F.rtrim("text", F.lit(WHITE))
    cut = ~F.substring(bare, -1, 1).isin(".", "!", "?")
    flags = both.select("conv_id", "turn", "role", "text", "copies", (F.length(bare) == 0).alias("blank"), later.alias("later"), cut.alias("cut"))
    return flags.select("conv_id", "turn", "role", "text", "copies", "blank", (~F.col("blank") & F.col("later")).alias("duplicate"), (~F.col("blank") & ~F.col("later") & F.col("cut")).alias("truncated"))


PIECE = {
    "conv_id": "long", "piece": "int", "whole": "boolean", "low": "long", "high": "long", "turns": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long",
    "first_initial": "string", "last_initial": "string", "paths": "array<struct<top:int,after:int,cost:bigint,audit:string>>", "cost": "long", "audit": "string", "repaired_sha256": "string",
}
RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


class _Piece:
    """A conversation, or the part of it that lies in one range."""

    def __init__(self, conv: int | None, piece: int, inner: bool) -> None:
        """``inner``: it begins inside the range, and may end there."""
        self.conv, self.piece, self.inner, self.low, self.high, self.turns = conv, piece, inner, None, None, 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.rows: list[tuple] = []
        self.said: list[tuple] = []

    def add(self, turn, role, text, copies, blank, duplicate, truncated) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        initial = role[:1]
        if self.rows:
            self.illegal += self.rows[-1][0] + initial not in LEGAL
        self.illegal += (copies - 1) * (2 * initial not in LEGAL)
        self.blank += copies * blank
        self.duplicate += copies * duplicate + (copies - 1) * (not blank and not duplicate)
        self.truncated += truncated
        self.rows.append((initial, blank or duplicate, truncated, copies - 1))
        if self.inner:
            self.said.append((role, text, copies - 1))

    def result(self, last: bool) -> tuple:
        whole = self.inner and not last
        paths, cost, audit, sha = [], None, None, None
        if whole:
            cost, audit = parsed(self.rows).best()
            sha = digest_of(repaired(audit, self.said))
        else:
            for after in range(4):
                stack = parsed(self.rows, (after,), False)
                for top in stack.layers[-1]:
                    found = stack.best(top)
                    paths.append({"top": top, "after": after, "cost": found[0], "audit": found[1]})
        counts = (self.blank, self.duplicate, self.truncated, self.illegal)
        return (self.conv, self.piece, whole, self.low, self.high, self.turns, *counts, self.rows[0][0], self.rows[-1][0], paths, cost, audit, sha)


def _pieces(batches):
    """A row per conversation and range; those at neither edge of the range are finished."""
    import pyarrow as pa
    from pyspark import TaskContext

    no, held, out = TaskContext.get().partitionId(), None, []

    def made():
        i64, i32, text = pa.int64(), pa.int32(), pa.string()
        path = pa.list_(pa.struct([("top", i32), ("after", i32), ("cost", i64), ("audit", text)]))
        kinds = [i64, i32, pa.bool_(), *[i64] * 7, text, text, path, i64, text, text]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=list(PIECE))

    for b in batches:
        for conv, *row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
            if held is None or held.conv != conv:
                if held is not None:
                    out.append(held.result(last=False))
                held = _Piece(conv, no, held is not None)
            held.add(*row)
        if len(out) >= 1000:
            yield made()
            out.clear()
    if held is not None:
        out.append(held.result(last=True))
        yield made()


def _joined(pieces):
    """One conversation (a pandas frame of its pieces): its counts, cost and audit."""
    import pandas as pd

    pieces = pieces.sort_values("piece")
    end = Stack(ACCEPTING, True)
    best = {top: end.best(top) for top in end.layers[-1]}
    for paths in reversed(pieces["paths"].tolist()):
        found: dict[int, tuple[int, str]] = {}
        for p in paths:
            cost, audit = best[p["after"]]
            whole = (cost + p["cost"], p["audit"] + audit)
            found[p["top"]] = min(found.get(p["top"], whole), whole)
        best = found
    known = pieces[pieces["low"].notna()]
    gaps = 0
    if len(known):
        met = int((known["high"].iloc[:-1].to_numpy() == known["low"].iloc[1:].to_numpy()).sum())
        gaps = int(known["high"].iloc[-1]) - int(known["low"].iloc[0]) + 1 - (int(known["turns"].sum()) - met)
    seams = (a + b not in LEGAL for a, b in zip(pieces["last_initial"].iloc[:-1], pieces["first_initial"].iloc[1:]))
    counts = [int(pieces[c].sum()) for c in ("blank", "duplicate", "truncated")]
    row = [gaps, *counts, int(pieces["illegal"].sum()) + sum(seams), *best[NOTHING]]
    return pd.DataFrame([[pieces["conv_id"].iloc[0], *row]], columns=["conv_id", *RESULT]).astype({"conv_id": "Int64"})


def _digests(batches):
    """conv_id, repaired_sha256 of a stream in which a conversation's audit stands before its rows in their order."""
    import pyarrow as pa

    def stream():
        for b in batches:
            yield from zip(*(b.column(i).to_pylist() for i in range(b.num_columns)))

    rows = stream()
    ahead = next(rows, None)
    while ahead is not None:
        conv, audit = ahead[0], ahead[1]
        ahead = next(rows, None)

        def own():
            nonlocal ahead
            while ahead is not None and ahead[1] is None:
                yield ahead[2:]
                ahead = next(rows, None)

        mine = own()
        sha = digest_of(repaired(audit, mine))
        for _ in mine:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([sha])], names=["conv_id", "repaired_sha256"])


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation, after damage."""
    spark = conversations.sparkSession
    bounded_batches(spark)
    n = shuffle_partitions(spark)
    rows = staged(with_faults(damaged(conversations)))
    turn = F.col("turn").asc_nulls_first()
    # ranges part by the beginnings of role and text only: keys are sampled for them
    dealt = rows.repartitionByRange(n, F.col("conv_id").asc_nulls_first(), turn, F.substring("role", 1, 32), F.substring("text", 1, 64))
    ordered = dealt.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), turn, "role", "text")
    pieces = staged(ordered.mapInArrow(_pieces, ", ".join(f"{k} {v}" for k, v in PIECE.items())))

    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    inner = pieces.where("whole").select("conv_id", gaps, *RESULT[1:], "repaired_sha256")
    kinds = ", ".join(f"{c} {'string' if c == 'audit' else 'long'}" for c in RESULT)
    edge = staged(pieces.where("not whole").groupBy("conv_id").applyInPandas(_joined, f"conv_id long, {kinds}"))
    # two conversations a range at most
    ends = F.broadcast(edge.select(F.col("conv_id").alias("of")))
    none = lambda kind: F.lit(None).cast(kind)
    theirs = rows.join(ends, F.col("conv_id").eqNullSafe(F.col("of")), "left_semi").select("conv_id", none("string").alias("audit"), "role", "text", (F.col("copies") - 1).alias("repeats"), "turn")
    heads = edge.select("conv_id", "audit", none("string").alias("role"), none("string").alias("text"), none("long").alias("repeats"), none("long").alias("turn"))
    stream = heads.unionByName(theirs).repartition(n, "conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), turn, "role", "text").drop("turn")
    hashed = stream.mapInArrow(_digests, "of long, repaired_sha256 string")
    split = edge.join(hashed, F.col("conv_id").eqNullSafe(F.col("of"))).select("conv_id", *RESULT, "repaired_sha256")
    done = staged(inner.unionByName(split))
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    done = done.withColumnRenamed("conv_id", "of")
    zero = {c: F.coalesce(F.col(c), F.lit("") if c == "audit" else F.lit(0).cast("long")).alias(c) for c in RESULT}
    sha = F.coalesce("repaired_sha256", F.lit(digest_of([]))).alias("repaired_sha256")
    return every.join(done, F.col("conv_id").eqNullSafe(F.col("of")), "left").select("conv_id", *zero.values(), sha)
