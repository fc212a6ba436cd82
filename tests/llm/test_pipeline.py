"""The pipeline, stage by stage, against plain versions of what each stage decides."""

import re

import numpy as np
import pytest

import corpus_pipeline
from shelfmark.llm import bpe, minmax, mixing, quality
from shelfmark.llm.common import documents, stored
from shelfmark.llm.queries import vocabulary_file
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def table(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages(spark):
    tokenizers = pytest.importorskip("tokenizers")
    (_, rules), (_, near), (_, scan), (_, mix), (_, encode) = corpus_pipeline.STAGES
    docs = documents(spark, SF)
    verdict = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    kept = stored(rules(spark, docs, SF), "t")
    assert table(kept) == [r for r in table(docs) if verdict[r[0]]] and kept.columns == docs.columns
    one = stored(near(spark, kept, SF), "t")
    groups = brute.near([(r.doc_id, r.text) for r in kept.collect()])
    assert table(one) == [r for r in table(kept) if groups[r[0]][1] == r[0]] and one.columns == docs.columns
    clean = stored(scan(spark, one, SF), "t")
    before = {r.doc_id: r.text for r in one.collect()}
    after = {r.doc_id: r.text for r in clean.collect()}
    assert before.keys() == after.keys() and clean.columns == docs.columns
    for d, text in before.items():
        if brute.secrets(text)[:3] == (0, 0, 0):
            assert after[d] == text or "<SECRET>" in after[d]
        else:
            assert brute.secrets(after[d])[:3] == (0, 0, 0)
    taken = {r.doc_id: r.uses for r in mixing.mix(clean).collect()}
    mixed = stored(mix(spark, clean, SF), "t")
    assert table(mixed) == sorted((r for r in table(clean) for _ in range(taken[r[0]])), key=repr) and mixed.columns == docs.columns
    t = tokenizers.Tokenizer.from_file(vocabulary_file())
    for r in encode(spark, mixed, SF).collect():
        assert r.ids == t.encode(after[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_ids_decode_to_the_stage_input(spark):
    texts = [None, "", " a  b\n", "é 😀 naïve ÀÉ", "it's 12345 <|endoftext|>", "x" * 3000]
    rows = [(k, "s", t) for k, t in enumerate(texts)] + [(r.doc_id, r.source, r.text) for r in documents(spark, SF).limit(200).collect()]
    want = sorted((d, brute.sha(t or "")) for d, _, t in rows)
    got = corpus_pipeline.encode(spark, spark.createDataFrame(rows, "doc_id long, source string, text string"), SF)
    assert sorted((r.doc_id, r.decoded_sha256) for r in got.collect()) == want


def test_encoding_takes_one_python_process_a_task_and_remembers_a_piece_once(spark):
    docs = documents(spark, SF).limit(300)
    out = corpus_pipeline.encode(spark, docs, SF)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    both = bpe.decode(bpe.encode(docs.select("doc_id", "text"), vocabulary_file()), vocabulary_file())
    assert sorted((r.doc_id, r.n_tokens, r.ids, r.decoded_sha256) for r in out.collect()) == sorted(
        (r.doc_id, len(r.ids), r.ids, brute.sha(r.decoded)) for r in both.collect())
    v = bpe.Vocabulary(vocabulary_file())
    for x in (whole := [" the", " reading", "12"]):
        assert len(v.cuts(x.encode())) == 1 and v.piece(x)
    assert list(v._known) == whole and not v._fragments


def test_quality_rules_store_no_texts(spark, monkeypatch):
    """Verdicts lie on disk without the texts, and find repeated ids, equal texts and rows without ids again."""
    kept, written = quality.stored, []
    monkeypatch.setattr(quality, "stored", lambda df, label: (written.append(df.columns), kept(df, label))[1])
    text = [r.text for r in documents(spark, SF).filter("length(text) > 400").orderBy("doc_id").limit(40).collect()]
    rows = [(k, t, "s", k) for k, t in enumerate(text)] + [(0, "# # #", "s", 1), (0, text[0], "s", 2), (None, text[1], None, 3), (None, None, "s", 4), (None, "", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _id long")
    found = corpus_pipeline.quality_rules(spark, docs, SF)
    assert found.columns == docs.columns and written and all("text" not in c for c in written)
    verdict = {r.text: r.kept for r in quality.judged(docs.select("doc_id", "text")).collect()}
    assert table(found) == sorted((r for r in rows if verdict[r[1]]), key=repr) and 0 < found.count() < len(rows)


def test_empty_and_awkward_tables(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long, kept int, position string"
    for k, rows in enumerate(([], [(1, None, None, None, None, 1, "p"), (None, "a b c " * 30, "en", "s", 3, 2, None), (2, "", "en", "s", 0, 3, "q")])):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{k}").count() >= 0


def test_rows_without_ids_and_clashing_names_in_dedup(spark):
    """One row of each group stays, whatever ids are missing and whatever the other columns are called."""
    text, other = " ".join(f"alpha{i}" for i in range(40)), " ".join(f"beta{i}" for i in range(40))
    rows = [(1, text), (None, text), (None, text + " omega"), (None, other), (None, other), (None, other.upper()), (2, None), (None, ""),
            (None, ""), (3, "  "), (4, "Ünïque ones"), (4, "Ünïque ones"), (None, "no words lost here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "1 AS _stays", "2 AS _same", "3 AS component", "4 AS k1", "'x' AS id", "5 AS `a``b`")
    got = minmax.deduplicated(docs)
    assert got.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
    chosen = [t for d, t in left if d is None and t and t.lower().startswith("beta")]
    assert len(chosen) == 1
    left.remove((None, chosen[0]))
    assert left == sorted([(1, text), (2, None), (None, ""), (3, "  "), (4, "Ünïque ones"), (None, "no words lost here")], key=repr)


def test_mixing_repeated_rows_and_missing_ids(spark):
    """Equal rows are taken like any others, and each use brings the whole row."""
    rows = [(1, "a b c", "s")] * 5 + [(None, "d e", "s")] * 3 + [(None, "f g h", None), (7, "one two three", "t"), (7, "one two", "t"), (8, None, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "9 AS position", "'q' AS _row", "'z' AS size")
    mixed = [(r.doc_id, r.text, r.source) for r in corpus_pipeline.mix_sources(spark, docs, SF).collect()]
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.uses
    count = {}
    for d, _, _ in mixed:
        count[d] = count.get(d, 0) + 1
    assert count == {d: n for d, n in taken.items() if n} and set(mixed) <= set(rows)


def test_seekers_blocks_and_waves_lose_no_link(spark, monkeypatch):
    """Groups of near copies whose pairs lie about the threshold, in blocks and waves of a few members."""
    rng = np.random.default_rng(2)
    rows = []
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(60)]
        for c in range(40):
            words = list(base)
            for k in rng.choice(60, rng.integers(0, 4), replace=False):
                words[k] = f"edit{g}x{c}x{k}"
            rows.append((len(rows), " ".join(words[:60 - int(rng.integers(0, 8))])))
    monkeypatch.setattr(minmax, "MEMBERS", 5)
    monkeypatch.setattr(minmax, "SEEKERS", 7)
    got = {r.doc_id: r.component_id for r in minmax.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: c for d, (_, c, _) in brute.near(rows).items()} if len(next(iter(brute.near(rows).values()))) == 3 else got == {
        d: v[1] for d, v in brute.near(rows).items()}


def test_working_tables_go_and_results_stay(spark):
    import os

    from shelfmark.llm import common

    made = []

    def build():
        inner = common.stored(spark.range(100).repartition(4), "inner")
        made.extend(inner.inputFiles())
        return inner.groupBy((inner.id % 7).alias("k")).count()

    out = common.settled(build, "outer")
    assert made and not any(os.path.exists(f.removeprefix("file://")) for f in made)
    assert out.count() == 7 and sum(r["count"] for r in out.collect()) == 100
