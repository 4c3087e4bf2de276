"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .op01_packing import pack
from .op02_warc import warc_round_trip
from .op03_ngram_join import ngram_join
from .op04_substring_dedup import substring_dedup
from .op05_toxicity import toxicity
from .op06_quality import quality_scores
from .op07_topk import top_k
from .op08_pitman_yor import score
from .op09_exact_dedup import exact_dedup
from .op10_mixing import mix
from .op11_repair import repair
from .op12_collocations import collocations
from .op13_secrets import secrets


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), width=3, percent=90)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def every_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 without its floor: lines and sentences of any number of words."""
    return substring_dedup(table(spark, sf_dir, "documents"), min_words=1)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of the subpackage; the pipeline counts as part of it."""
    own = (op1_packing, op2_warc, op3_ngram_join, op4_substring_dedup, op5_toxicity, op6_quality, op7_topk, op8_pitman_yor, op9_exact_dedup, op10_mixing, op11_repair, op12_collocations, op13_secrets)
    return {f.__name__: f for f in (*own, pipeline, every_line_dedup)}


OP2_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages),
h AS (SELECT page_id, octet_length(raw) AS n, sha1(raw) AS hex, max(page_id) OVER (PARTITION BY raw) AS best FROM p),
b AS (SELECT *, list_aggregate(list_transform(range(40), lambda i: lpad(bin((('0x' || hex[i + 1])::INTEGER)), 4, '0')), 'string_agg', '') AS bits FROM h)
SELECT page_id, n::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (16 * bits[5 * i + 1]::INTEGER + 8 * bits[5 * i + 2]::INTEGER + 4 * bits[5 * i + 3]::INTEGER
            + 2 * bits[5 * i + 4]::INTEGER + bits[5 * i + 5]::INTEGER + 1)::INTEGER, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = best THEN NULL ELSE best END::BIGINT AS refers_to
FROM b
"""

OP4_SQL = r"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS p FROM documents),
p AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM d WHERE text IS NOT NULL),
w0 AS (
  SELECT doc_id, i, regexp_extract(piece, '[^\x20\x09-\x0D]+') AS word, regexp_extract(piece, '^[\x20\x09-\x0D]*') AS lead,
         sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS "end" FROM p),
w AS (
  SELECT *, "end" - length(word) AS start, CASE WHEN i = 1 THEN 2 ELSE length(lead) - length(replace(lead, chr(10), '')) END AS breaks,
         right(lag(word) OVER (PARTITION BY doc_id ORDER BY i), 1) IN ('.', '!', '?', '。', '！', '？') AS stop,
         count(*) OVER (PARTITION BY doc_id) AS n,
         translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM w0),
s AS (
  SELECT doc_id, i, n, 'line' AS kind FROM w WHERE breaks > 0 UNION ALL
  SELECT doc_id, i, n, 'sentence' FROM w WHERE breaks > 1 OR stop),
e AS (SELECT *, coalesce(lead(i) OVER (PARTITION BY doc_id, kind ORDER BY i), n + 1) AS stop FROM s),
j AS (SELECT a.doc_id, a.i, min(b.stop) AS stop FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.kind = b.kind AND b.i >= a.i AND b.stop - a.i >= 4 AND b.i < a.i + 4 GROUP BY a.doc_id, a.kind, a.i),
q AS (SELECT doc_id, i, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), n + 1) AS stop FROM w WHERE breaks > 1),
r AS (
  SELECT DISTINCT doc_id, i, stop FROM j UNION
  SELECT doc_id, i, stop FROM q WHERE stop - i >= 4 AND EXISTS (SELECT 1 FROM w WHERE w.doc_id = q.doc_id AND w.i > q.i AND w.i < q.stop AND breaks = 1)),
l AS (SELECT doc_id, list(low ORDER BY i) AS words, list(start ORDER BY i) AS starts, list("end" ORDER BY i) AS ends FROM w GROUP BY doc_id),
u AS (SELECT doc_id, starts[i]::BIGINT AS start, ends[stop - 1]::BIGINT AS "end", md5(array_to_string(words[i:stop - 1], ' ')) AS digest FROM r JOIN l USING (doc_id)),
g AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY doc_id, start) AS rank FROM u),
c AS (SELECT g.*, text, max(g."end") OVER (PARTITION BY doc_id ORDER BY start, g."end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g JOIN documents USING (doc_id) WHERE rank > 1),
m AS (
  SELECT *, sum(CASE WHEN before IS NULL OR (start > before AND NOT regexp_matches(substr(text, before + 1, start - before), '^[\x20\x09-\x0D]*$')) THEN 1 ELSE 0 END)
         OVER (PARTITION BY doc_id ORDER BY start, "end") AS run FROM c),
v AS (SELECT doc_id, run, min(start) AS start, max("end") AS "end", count(*) AS units, any_value(text) AS text FROM m GROUP BY doc_id, run),
k AS (
  SELECT *, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY run), -1) AS before,
         len(regexp_extract_all(substr(text, start + 1, "end" - start), '[^\x20\x09-\x0D]+')) AS words FROM v),
o AS (
  SELECT doc_id, string_agg(substr(text, before + 2, greatest(start - before - 1, 0)), '' ORDER BY run) || substr(any_value(text), max("end") + 2) AS rest,
         string_agg(start || '-' || "end", ' ' ORDER BY run) AS spans, sum(units)::BIGINT AS removed_units, sum(words)::BIGINT AS removed_words, max(words)::BIGINT AS longest
  FROM k GROUP BY doc_id)
SELECT doc_id, CASE WHEN spans IS NULL THEN text ELSE rest END AS text, coalesce(spans, '') AS spans, coalesce(removed_units, 0) AS removed_units,
       coalesce(removed_words, 0) AS removed_words, coalesce(longest, 0) AS longest, (coalesce(longest, 0) >= 25)::INT AS predicted
FROM documents LEFT JOIN o USING (doc_id)
"""

#: The same with a floor of one word.
EVERY_LINE_SQL = OP4_SQL.replace("stop - a.i >= 4 AND b.i < a.i + 4", "stop - a.i >= 1 AND b.i < a.i + 1").replace("stop - i >= 4", "stop - i >= 1")

OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND list_aggregate(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END), 'sum') = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w::DOUBLE[], c.w::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM d GROUP BY source),
w AS (SELECT *, CASE (no - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
o AS (
  SELECT *,
         sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER lean, 0) AS left_words,
         sum(weight) OVER () - coalesce(sum(weight) OVER lean, 0) AS left_weight,
         row_number() OVER (ORDER BY 3.0 * source_size / weight, no) AS pos
  FROM w WINDOW lean AS (ORDER BY 3.0 * source_size / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, 3 * source_size * left_weight <= weight * left_words AS capped FROM o),
l AS (SELECT arg_min(left_words, pos) AS lw, arg_min(left_weight, pos) AS lg FROM c WHERE NOT capped),
t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE weight * lw::DOUBLE / lg::DOUBLE END AS target
  FROM c LEFT JOIN l ON true),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, least(floor(t.target)::BIGINT, 3 * t.source_size) AS stream,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix-1' || coalesce(d.doc_id::VARCHAR, 'null')), d.doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0
            ELSE (stream // source_size) * size + greatest(least(a + size, stream % source_size) - a, 0) END::BIGINT AS taken
FROM p
"""


OP11_SQL = r"""
WITH RECURSIVE
k AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
f AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::BIGINT)),
             lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 20 AS fate
  FROM k),
g AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE fate WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM f WHERE fate <> 0),
o AS (
  SELECT *, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS occ FROM g),
p AS (
  SELECT conv_id, turn, role, text, pos, role[1] AS ini, bare = '' AS blank, bare <> '' AND occ > 1 AS dup, bare <> '' AND occ = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS cut,
         coalesce(lag(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) || role[1] NOT IN ('su', 'ua', 'au'), false) AS bad FROM o),
c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
         count(*) FILTER (cut) AS truncated, count(*) FILTER (bad) AS illegal, count(*) AS rows FROM p GROUP BY conv_id),
t AS (
  SELECT conv_id, rows + 1 AS pos, {'c': 0::BIGINT, 'a': ''} AS n, {'c': 4::BIGINT, 'a': 'II'} AS s, {'c': 2::BIGINT, 'a': 'I'} AS u, {'c': 0::BIGINT, 'a': ''} AS a FROM c
  UNION ALL
  SELECT conv_id, pos, list_min([n, {'c': cu.c + 2, 'a': 'I' || cu.a}]), list_min([s, {'c': cu.c + 2, 'a': 'I' || cu.a}]), cu, ca FROM (
    SELECT conv_id, pos, n, s, list_min([u, {'c': a.c + 2, 'a': 'I' || a.a}]) AS cu, list_min([a, {'c': u.c + 2, 'a': 'I' || u.a}]) AS ca FROM (
      SELECT t.conv_id, p.pos,
             list_min([{'c': t.n.c + 3, 'a': 'D' || t.n.a}, CASE WHEN NOT blank AND NOT dup THEN {'c': t.u.c + 2 + cut::INT, 'a': 'R' || t.u.a} END,
                       CASE WHEN NOT blank AND NOT dup AND ini = 'u' THEN {'c': t.u.c + cut::INT, 'a': 'K' || t.u.a} WHEN NOT blank AND NOT dup AND ini = 's' THEN {'c': t.s.c + cut::INT, 'a': 'K' || t.s.a} END]) AS n,
             list_min([{'c': t.s.c + 3, 'a': 'D' || t.s.a}, CASE WHEN NOT blank AND NOT dup THEN {'c': t.u.c + CASE WHEN ini = 'u' THEN 0 ELSE 2 END + cut::INT, 'a': CASE WHEN ini = 'u' THEN 'K' ELSE 'R' END || t.u.a} END]) AS s,
             list_min([{'c': t.u.c + 3, 'a': 'D' || t.u.a}, CASE WHEN NOT blank AND NOT dup THEN {'c': t.a.c + CASE WHEN ini = 'a' THEN 0 ELSE 2 END + cut::INT, 'a': CASE WHEN ini = 'a' THEN 'K' ELSE 'R' END || t.a.a} END]) AS u,
             list_min([{'c': t.a.c + 3, 'a': 'D' || t.a.a}, CASE WHEN NOT blank AND NOT dup THEN {'c': t.u.c + CASE WHEN ini = 'u' THEN 0 ELSE 2 END + cut::INT, 'a': CASE WHEN ini = 'u' THEN 'K' ELSE 'R' END || t.u.a} END]) AS a
      FROM t JOIN p ON p.conv_id IS NOT DISTINCT FROM t.conv_id AND p.pos = t.pos - 1))),
b AS (SELECT conv_id, n.c AS cost, n.a AS audit FROM t WHERE pos = 1),
e AS (SELECT conv_id, audit, generate_subscripts(list, 1) AS i, unnest(list) AS letter FROM (SELECT conv_id, audit, string_split(audit, '') AS list FROM b WHERE audit <> '')),
q AS (
  SELECT conv_id, i, letter, count(*) FILTER (letter <> 'I') OVER w AS pos, count(*) FILTER (letter <> 'D') OVER w AS line FROM e
  WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
y AS (SELECT q.*, p.role, p.text, max(letter = 'K' AND ini = 's' AND line = 1) OVER (PARTITION BY q.conv_id) AS sys FROM q LEFT JOIN p ON q.conv_id IS NOT DISTINCT FROM p.conv_id AND q.pos = p.pos),
z AS (
  SELECT conv_id, sha256(string_agg(CASE letter WHEN 'K' THEN role ELSE CASE WHEN (line - sys::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY line)) AS sha
  FROM y WHERE letter <> 'D' GROUP BY conv_id)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k
LEFT JOIN c ON k.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN b ON k.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN z ON k.conv_id IS NOT DISTINCT FROM z.conv_id
"""

OP12_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
t AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
m AS (SELECT lang, count(*) AS n FROM t GROUP BY lang),
f AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k AS words, count(*) AS a FROM t, range(1, 6) r(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
x AS (SELECT *, string_split(phrase, ' ') AS w FROM f),
s AS (
  SELECT c.lang, c.phrase, c.a, c.w, n, k, l.a AS l, r.a AS r, 1000::HUGEINT * c.a * n // (l.a::HUGEINT * r.a) AS score
  FROM x c JOIN m USING (lang) JOIN range(1, 5) q(k) ON k < c.words
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')),
b AS (SELECT lang, phrase, a, n, min({'score': score, 'k': k, 'l': l, 'r': r}) AS low FROM s GROUP BY ALL),
u AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS around FROM x, range(2, 5) q(k), range(1, 5) j(i) WHERE k < words AND i + k - 1 <= words GROUP BY ALL)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY low.score DESC, a DESC, b.phrase) AS rank, b.phrase, a, low.l AS l, low.r AS r, n, low.score::BIGINT AS score
  FROM b LEFT JOIN u USING (lang, phrase) WHERE around IS NULL OR 100 * around < 100 * a) WHERE rank <= 2000
"""

_SPANS = """SELECT id, '{kind}' AS kind, {no} AS no, unnest(range(1, len(whole) + 1)) AS i, gaps, whole, value FROM (
    SELECT id, string_split_regex(text, {regex}) AS gaps, regexp_extract_all(text, {regex}) AS whole, regexp_extract_all(text, {regex}, {group}) AS value FROM d)"""
_KINDS = [
    ("assign", r"""'(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'""", 2),
    ("access", "'AKIA[A-Z0-9]+'", 0),
    ("hex", "'[0-9a-f]+'", 0),
    ("owned", "'[A-Za-z0-9+/_=-]{20,}'", 0),
]
OP13_SQL = (
    "WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text, coalesce(source, chr(0)) AS owner FROM documents),\nm AS ("
    + "\n  UNION ALL ".join(_SPANS.format(kind=kind, no=no, regex=regex, group=group) for no, (kind, regex, group) in enumerate(_KINDS))
    + r"""),
p AS (
  SELECT id, kind, no, value[i] AS value, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS start, length(whole[i]) AS n
  FROM m WHERE length(value[i]) >= CASE kind WHEN 'assign' THEN 8 WHEN 'access' THEN 16 WHEN 'hex' THEN 32 ELSE 20 END),
v AS (
  SELECT id, kind, no, value, start::BIGINT AS start, (start + n)::BIGINT AS stop,
         regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= 10
         AND NOT regexp_matches(value, '(?i)example|sample|dummy|changeme|placeholder|your|xxxx|0000|123456') AS looks FROM p),
s AS (
  SELECT * FROM v WHERE no < 3 UNION ALL
  SELECT * FROM v WHERE no = 3 AND looks AND NOT EXISTS (SELECT 1 FROM v b WHERE b.id = v.id AND b.no < 3 AND b.start < v.stop AND b.stop > v.start)),
o AS (SELECT value, count(DISTINCT owner) AS owners FROM s JOIN d USING (id) GROUP BY value),
j AS (SELECT *, owners = 1 AND looks AS live, kind || ':' || start || ':' || stop AS span FROM s JOIN o USING (value) WHERE no < 3 OR (owners = 1 AND looks)),
a AS (
  SELECT id, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex, string_agg(span, ',' ORDER BY start, no) FILTER (no < 3) AS base,
         string_agg(span, ',' ORDER BY start, no) AS spans, count(*) FILTER (no = 3) AS n_owned, count(*) FILTER (live) AS n_live, count(*) FILTER (owners >= 3) AS n_example,
         string_agg(span, ',' ORDER BY start, no) FILTER (live) AS live FROM j GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_owned, 0) AS n_owned, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(live, '') AS live
FROM d LEFT JOIN a USING (id)
"""
)


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op4_substring_dedup": OP4_SQL, "every_line_dedup": EVERY_LINE_SQL, "op7_topk": OP7_SQL, "op9_exact_dedup": OP9_SQL, "op10_mixing": OP10_SQL, "op11_repair": OP11_SQL, "op12_collocations": OP12_SQL, "op13_secrets": OP13_SQL}
