import corpus_pipeline
import pytest
from test_packing import check_packing

from rxweave.llm.common import stored

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "stage")
        out.append(docs)
    return out


def test_stages_keep_the_columns_of_documents(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]
    for before, after in zip(stages[:-2], stages[1:-1], strict=True):
        assert after.columns == corpus_pipeline.COLUMNS
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}


def test_quality_keeps_what_its_score_says_and_nearly_all_good_documents(spark, stages):
    kept = {r.doc_id for r in stages[1].collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id").collect()
    assert sum(r.doc_id in kept for r in labels) >= 0.95 * len(labels)


def test_line_stage_only_removes_lines(stages):
    before = {r.doc_id: r.text for r in stages[1].collect()}
    for r in stages[2].collect():
        rest = iter((before[r.doc_id] or "").split("\n"))
        assert r.n_chars == len(r.text or "") and all(any(x == y for y in rest) for x in (r.text or "").split("\n") if r.text)


def test_one_document_of_each_similar_group_stays(stages):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    before = {r.doc_id: shingles(r.text) for r in stages[2].collect()}
    kept = {r.doc_id for r in stages[3].collect()}
    at = {}
    for k, s in before.items():
        for x in s:
            at.setdefault(x, []).append(k)
    like = {k: set() for k in before}
    for k, s in before.items():
        for o in {o for x in s for o in at[x]} - {k}:
            if len(s & before[o]) >= 0.8 * len(s | before[o]):
                like[k].add(o)
    seen = set()
    for k in sorted(before):
        if k in seen:
            continue
        group, todo = {k}, [k]
        while todo:
            new = like[todo.pop()] - group
            group |= new
            todo += new
        seen |= group
        assert kept & group == {min(group)}


def test_no_long_benchmark_passage_is_left(spark, stages):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    grams = {tuple(w[i : i + 13]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [words(r.text)] for i in range(len(w) - 12)}
    hit = lambda t: any(tuple(w[i : i + 13]) in grams for w in [words(t)] for i in range(len(w) - 12))
    before = {r.doc_id: hit(r.text) for r in stages[3].collect()}
    kept = {r.doc_id for r in stages[4].collect()}
    assert any(before.values()) and not any(before[k] for k in kept)
    assert len(kept) >= len(before) - 3 * sum(before.values())


def test_the_rest_is_packed_whole(stages):
    check_packing(stages[5].collect(), {r.doc_id: r.text for r in stages[4].collect()}, 2048)


def test_odd_rows_pass_through_every_stage(spark):
    from pyspark.sql import functions as F

    rng = __import__("random").Random(5)
    good = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars between 400 and 2000 and lang = 'en'").orderBy("doc_id").limit(12).collect()]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    other = lambda t: " ".join(rng.sample(t.split(), len(t.split())))
    rows = [(None, None), (None, ""), (1, None), (2, ""), (3, good[0]), (3, good[0]), (None, good[1]), (None, good[1] + " more"), (None, other(good[2]) + "\n" + item), (4, other(good[3]) + "\n" + item), *enumerate(map(other, good[4:]), 10)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("node", F.lit("x")).withColumn("key", F.lit(1))
    kept = {}
    for (name, stage), empty in zip(corpus_pipeline.STAGES, [docs.limit(0)] * 5, strict=True):
        assert stage(spark, empty, SF).count() == 0
        kept[name] = stage(spark, docs, SF).collect()
    lines, near, clean = (kept[n] for n in ("line dedup", "SimHash near-dedup", "benchmark decontamination"))
    assert len(lines) == len(rows) and sum(r.text is None for r in lines) == 2
    assert sorted((r.doc_id or 0, r.text or "") for r in near) == sorted([(1, ""), (3, good[0]), (0, next(r.text for r in near if r.doc_id is None and r.text.startswith(good[1]))), *[(k or 0, t) for k, t in rows[8:]]])
    assert sorted((r.doc_id or 0, r.text or "") for r in clean) == sorted((k or 0, t or "") for k, t in rows if not (t or "").endswith(item))
    assert len(kept["best-fit packing"]) >= len(rows)
