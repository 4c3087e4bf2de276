"""The pipeline's stages against plain versions, each on its own input, and on tables with every odd case."""

import re
from collections import Counter

import corpus_pipeline as pipeline
import pytest

from tablero.llm import op06_quality as op6
from tablero.llm import op10_mixing as op10

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def same(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def shingles(text, width=5):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def kept_exact(rows):
    best = {}
    for i, text in rows:
        rank = (-len(text or ""), i is None, i or 0)
        best[same(text)] = min(best.get(same(text), (rank, i)), (rank, i), key=lambda x: x[0])
    kept = {i for _, i in best.values()}
    return sorted({(str(i), text) for i, text in rows if i in kept}, key=str)


def kept_near(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted(i for k, (i, _) in enumerate(sets) if least[find(k)] == i)


@pytest.fixture(scope="module")
def folder(spark, nasty_rows, tmp_path_factory):
    """A data folder of the odd rows (without the one without id) with labels; extra columns have the operators' own names."""
    base = tmp_path_factory.mktemp("corpus")
    rows = [r for r in nasty_rows if r[0] is not None]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, sig long, token string, start long"
    spark.createDataFrame(rows, schema).write.parquet(f"file://{base}/documents.parquet")
    spark.createDataFrame([(r[0], int(len(r[1] or "") > 5), 0) for r in rows[::2]], "doc_id long, quality int, toxic int").write.parquet(f"file://{base}/labels.parquet")
    return f"file://{base}"


def test_stages_against_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, stages = docs.columns, dict(pipeline.STAGES)

    judged = stages["quality"](spark, docs, folder)
    good = {r["doc_id"] for r in op6.quality_scores(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1").collect()}
    assert judged.columns == columns and sorted(r["doc_id"] for r in judged.collect()) == sorted(r["doc_id"] for r in docs.collect() if r["doc_id"] in good)

    exact = stages["exact_dedup"](spark, docs, folder)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert exact.columns == columns and sorted(((str(r["doc_id"]), r["text"]) for r in exact.collect()), key=str) == kept_exact(rows)

    near = stages["ngram_join"](spark, exact, folder)
    assert near.columns == columns and sorted(r["doc_id"] for r in near.collect()) == kept_near([(r["doc_id"], r["text"]) for r in exact.collect()])

    mixed = stages["mixing"](spark, near, folder)
    taken = {r["doc_id"]: r["taken"] for r in op10.mix(near).collect() if r["taken"]}
    words = Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += len(re.findall("[^\x20\x09-\x0d]+", r["text"]))
    assert mixed.columns == columns and words == taken

    packed = stages["packing"](spark, mixed, folder).collect()
    pieces = Counter(r["doc_id"] for r in packed if r["start"] == 0)
    assert pieces == Counter(r["doc_id"] for r in mixed.collect())
    assert pipeline.run(spark, folder).count() > 0


def test_rows_without_id_and_empty_tables(spark, nasty, empty, folder, tmp_path):
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, nasty, folder).columns == nasty.columns and stage(spark, empty, folder).count() == 0, name
        assert stage(spark, nasty, folder).count() > 0, name
    empty.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert pipeline.run(spark, f"file://{tmp_path}").count() == 0
