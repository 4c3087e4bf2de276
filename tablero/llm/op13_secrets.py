"""Secret scan with corpus-wide ownership frequency, by DataFrame functions only.

Every text is scanned for assignments, access keys and hexadecimal keys (the base spans, which always stay) and for bare
tokens that look like credentials. Positions come from the lengths of the matches and of the texts between them, inside
the row. The values of all spans are hashed and counted over the corpus by distinct owners and repositories: a value that
``shared`` owners or more hold is a widely copied example; a value that one owner holds and that looks live is owner-specific.
Bare tokens outside base spans are added as ``owned`` spans if their value is owner-specific.

Hot values fold by (value, owner, repository) and then by (value, owner) before they are counted; verdicts go back to the
spans by a join that adaptive execution splits. A document's spans end in one cell, so they meet in one task.

Null text: empty, no spans. Null owner or repository: counted as one owner or repository of its own. Empty table: no rows.
Repeated rows: each is scanned and returned. Very long texts are scanned whole; the work for n matches in one text grows
as n to the 1.5. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Kinds in their order, patterns, group of the value, least characters of it.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
BASE = [("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32)]

#: Bare tokens, and what looks like a credential: letters and digits, enough different characters, no placeholder.
BARE = r"[A-Za-z0-9+/_=-]{20,}"
DISTINCT = 10
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your|xxxx|0000|123456"

#: Lengths are summed in blocks of so many matches.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def sums_before(sizes: Column) -> Column:
    """Exclusive prefix sums of a non-empty array."""
    add = lambda a, b: a + b
    blocks = lambda x: F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int"))
    whole = lambda x: F.transform(blocks(x), lambda b: F.aggregate(F.slice(x, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0).cast("long"), add))
    bases = lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda b: F.aggregate(F.slice(x, F.lit(1), b), F.lit(0).cast("long"), add))
    inner = lambda x, i: F.aggregate(F.slice(x, i - i % BLOCK + 1, i % BLOCK), F.lit(0).cast("long"), add)
    return let(sizes, lambda x: let(bases(whole(x)), lambda y: F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda i: y[F.floor(i / BLOCK).cast("int")] + inner(x, i))))


def looks_live(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= DISTINCT) & ~value.rlike(PLACEHOLDER)


def spans_of(text: Column, kind: str, no: int, regex: str, group: int, least: int) -> Column:
    """Array of (start, no, end, kind, value): leftmost matches whose value has ``least`` characters, in code points."""

    def placed(p: Column) -> Column:
        gaps = p["gaps"]
        steps = F.zip_with(gaps, p["whole"], lambda g, m: (g + F.coalesce(F.length(m), F.lit(0))).cast("long"))

        def span(i: Column, before: Column) -> Column:
            start = before[i] + gaps[i]
            value = p["value"][i]
            return F.struct(start.alias("start"), F.lit(no).alias("no"), (start + F.length(p["whole"][i])).alias("end"), F.lit(kind).alias("kind"), value.alias("value"))

        every = let(sums_before(steps), lambda before: F.transform(F.sequence(F.lit(0), F.size(p["whole"]) - 1), lambda i: span(i, before)))
        return F.filter(every, lambda s: F.length(s["value"]) >= least)

    found = F.struct(
        F.transform(F.split(text, regex, -1), F.length).alias("gaps"),
        F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(regex), F.lit(group)).alias("value"),
    )
    none = F.array().cast("array<struct<start:bigint,no:int,end:bigint,kind:string,value:string>>")
    return F.when(text.rlike(regex), let(found, placed)).otherwise(none)


def joined(spans: Column) -> Column:
    """kind:start:end of an array of spans in their order."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["no"], s["end"], s["kind"])))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def ownership(values: DataFrame) -> DataFrame:
    """hash, owners, repositories of (hash, owner, repository) rows; repeated rows count once."""
    per_repository = values.select("hash", "owner", "repository").distinct()
    per_owner = per_repository.groupBy("hash", "owner").agg(F.count("*").alias("held"))
    return per_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("held").alias("repositories"))


def secrets(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id", shared: int = 3) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live, n_example, live.

    ``spans`` holds the base spans and the added ``owned`` ones, ``live`` those of them whose value is owner-specific and
    looks live, n_example counts those whose value ``shared`` owners or more hold.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), body.alias("text"))
    base = F.concat(*(spans_of(F.col("text"), kind, no, regex, group, least) for no, (kind, regex, group, least) in enumerate(BASE)))
    bare = F.filter(spans_of(F.col("text"), "owned", len(BASE), BARE, 0, 1), lambda s: looks_live(s["value"]))
    found = staged(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repository", base.alias("base"), bare.alias("bare")))
    some = F.size("base") + F.size("bare") > 0

    spans = found.where(some).select("row", "owner", "repository", F.explode(F.concat("base", "bare")).alias("s")).select("row", "owner", "repository", "s.*")
    # a bare token that touches a base span of its document is no finding of its own; equal starts sort base spans first
    is_base = F.col("no") < len(BASE)
    near = Window.partitionBy("row").orderBy("start", "no")
    ended = F.max(F.when(is_base, F.col("end"))).over(near.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.min(F.when(is_base, F.col("start"))).over(near.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(F.col("ended"), F.lit(0)) <= F.col("start")) & (F.col("begins").isNull() | (F.col("begins") >= F.col("end")))
    spans = spans.withColumn("ended", ended).withColumn("begins", begins).where(is_base | free)
    spans = staged(spans.select("row", "owner", "repository", "start", "no", "end", "kind", F.sha2("value", 256).alias("hash"), looks_live(F.col("value")).alias("looks_live")))

    judged = spans.join(ownership(spans), "hash")
    judged = judged.withColumn("live", (F.col("owners") == 1) & F.col("looks_live")).where((F.col("no") < len(BASE)) | F.col("live"))
    span = F.struct("start", "no", "end", "kind")
    per_row = judged.groupBy("row").agg(
        F.collect_list(span).alias("all"),
        F.collect_list(F.when(F.col("live"), span)).alias("alive"),
        F.count_if(F.col("no") == len(BASE)).alias("n_owned"),
        F.count_if(F.col("owners") >= shared).alias("n_example"),
    )
    with_spans = found.where(some).join(per_row, "row", "left")
    lists = "array<struct<start:bigint,no:int,end:bigint,kind:string>>"
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    columns = [
        F.col("doc_id"), *(number(kind) for kind, *_ in BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"),
        F.coalesce("n_owned", F.lit(0)).alias("n_owned"), F.size("alive").cast("long").alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"), joined(F.col("alive")).alias("live"),
    ]
    empty = F.array().cast(lists)
    filled = with_spans.withColumn("all", F.coalesce("all", empty)).withColumn("alive", F.coalesce("alive", empty))
    nothing = found.where(~some).withColumn("all", empty).withColumn("alive", empty).withColumn("n_owned", F.lit(0).cast("long")).withColumn("n_example", F.lit(0).cast("long"))
    return filled.select(*columns).unionByName(nothing.select(*columns))
