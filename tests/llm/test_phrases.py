"""Fingerprints, collocations and spelling variants against plain versions, with the awkward rows added."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import collocations, fingerprints, spelling
from shelfmark.llm.queries import QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.01"
HUGE = " ".join(f"wordnumber{i % 4001} of{i % 13}" for i in range(200_000))  # 3 MB
AWKWARD = [
    (900_001, None, None), (900_002, "", "en"), (900_003, " \n\t ", ""), (900_004, HUGE, "en"), (900_005, "one", "en"),
    (900_006, "É" * 9 + " Éa-éà÷×ÿßÀ abcdefgh abcdefgh", "fr"), (900_007, "a" * 5000, "en"), (900_008, "😀 naïve ÀÉ " * 40, None),
    (900_009, "x y z\x0bx y z\x0cx y z; x y z? x y z", "en"), (900_010, "Straße straßen\tSTRASSE straße", "de")]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def rows():
    table = pd.read_parquet(f"{SF}/documents.parquet")
    return [(int(d), t, la) for d, t, la in zip(table.doc_id, table.text, table.lang)] + AWKWARD


@pytest.fixture(scope="module")
def docs(spark, rows):
    """The extra columns bear names that the operators use themselves."""
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in (
        "word", "n", "rank", "range", "level", "labels", "hashes", "half", "_k1", "_terms", "run", "h")}).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- spelling -------------------------------------------------------------

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def test_spelling(docs, rows):
    got = [tuple(r[c] for c in COLUMNS) for r in spelling.variants(docs).collect()]
    want = brute.spelling([(d, t) for d, t, _ in rows])
    assert len(got) == len(want) and set(got) == want
    assert any(f for _, f, *_ in want)


def test_spelling_of_words_with_chains_ties_and_long_ones(spark):
    """Words over few letters, so that nearly all are near others; accented letters of one group; forms of forms."""
    rng = random.Random(4)
    words = {"".join(rng.choice("aeàæ") for _ in range(rng.randint(7, 9))) for _ in range(1500)}
    words |= {"z" * 7, "z" * 8, "z" * 9, "q" * 4000, "q" * 3999 + "x", "q" * 4001}
    table = [(w, rng.choice((2, 3, 40, 50, 600, 600, 9000))) for w in sorted(words)]
    n = dict(table)
    got = {r["word"]: r for r in spelling.grouped(spark.createDataFrame(table, "word string, n long")).collect()}
    assert set(got) == words
    letters = sorted(set("".join(words)))
    form = {}
    for w in words:
        if len(w) > 100:
            near = {x for x in words if len(x) > 100 and x != w and abs(len(x) - len(w)) <= 1 and not {x, w} == {"q" * 3999 + "x", "q" * 4001}}
        else:
            edits = {w[:i] + w[i + 1:] for i in range(len(w))} | {w[:i] + c + w[i + k:] for i in range(len(w) + 1) for c in letters for k in (0, 1)}
            near = (edits & words) - {w}
        assert got[w]["n_near"] == len(near), w[:20]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
        assert got[w]["form"] == form[w]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        assert got[w]["root"] == root
    assert any(form[form[w]] for w in words if form[w])


def test_spelling_of_repeated_rows_null_ids_and_nothing(spark, empty):
    table = [(None, "Quietly quietly spoken", None)] * 2 + [(7, "Loudest loudest", None)] * 3
    got = {tuple(r[c] for c in COLUMNS) for r in spelling.variants(spark.createDataFrame(table, SCHEMA)).collect()}
    assert got == brute.spelling([(d, t) for d, t, _ in table]) and len(got) >= 1
    assert spelling.variants(empty).collect() == []


def test_spelling_in_small_blocks(docs, rows, monkeypatch):
    monkeypatch.setattr(spelling, "SEARCHED", 7)
    monkeypatch.setattr(spelling, "VERIFIED", 300)
    words = spelling.vocabulary(docs).filter("n >= 4")
    small = {tuple(r[c] for c in COLUMNS) for r in spelling.grouped(words).collect()}
    monkeypatch.undo()
    assert small == {tuple(r[c] for c in COLUMNS) for r in spelling.grouped(words).collect()}


# --- collocations ---------------------------------------------------------

PHRASE = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def phrases(df):
    rows = [tuple(r[c] for c in PHRASE) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_collocations(docs, rows):
    want = brute.collocations([(la, t) for _, t, la in rows])
    assert phrases(collocations.collocations(docs)) == want
    assert {x[0] for x in want} >= {"de", "en", "es", "fr", "und"}


def test_collocations_in_many_shards_and_ranges(docs, rows, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD_WORDS", 1009)
    monkeypatch.setattr(collocations, "BLOCK", 700)
    monkeypatch.setattr(collocations, "RANGE_GRAMS", 5000)
    assert phrases(collocations.collocations(docs, 50)) == brute.collocations([(la, t) for _, t, la in rows], 50)


def test_collocations_with_products_beyond_64_bits(spark):
    n = 10 ** 13
    table = [(1, "en", "the", 1, None, None, 3 * n), (1, "en", "end", 2, None, None, 2 * n + 7), (2, None, None, 1, 2, 12, 2 * n - 1), (0, "en", None, None, None, None, 9 * n)]
    got = collocations.candidates(spark.createDataFrame(table, collocations.UNITED)).collect()
    a, left, right = 2 * n - 1, 3 * n, 2 * n + 7
    assert [(r.phrase, r.a, r.l, r.r, r.score) for r in got] == [("the end", a, left, right, 1_000_000 * a * a // (left * right))]


def test_scores_are_floored_not_rounded(spark):
    """1000000 a a / (l r) = 999999.9999999...: just below a whole number."""
    big = 10 ** 12
    table = [(1, "en", "x", 1, None, None, big), (1, "en", "y", 2, None, None, big + 1), (2, None, None, 1, 2, 12, big)]
    assert [r.score for r in collocations.candidates(spark.createDataFrame(table, collocations.UNITED)).collect()] == [999_999]


def test_collocations_of_repeated_rows_and_nothing(spark, empty):
    table = [(None, "new york city. new york! York", None)] * 12 + [(3, None, "en"), (4, "", None)]
    assert phrases(collocations.collocations(spark.createDataFrame(table, SCHEMA))) == brute.collocations([(la, t) for _, t, la in table])
    assert collocations.collocations(empty).collect() == []


# --- fingerprints ---------------------------------------------------------

def test_fingerprints(docs, rows):
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    by_text, near, apart = {}, [], []
    want = brute.edited([(d, t) for d, t, _ in rows])
    for d, text, _ in rows:
        n, changed, after = want[d]
        r = got[d]
        assert (r.n_chars, r.edited_sha256, r.next_id) == (n, brute.sha(changed), after)
        assert by_text.setdefault(text or "", r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_next == 1) == (r.fingerprint == got[after].fingerprint)
        assert (r.near_edited == 1) == (r.fingerprint == r.edited_fingerprint)
        if changed in by_text:
            assert r.edited_fingerprint == by_text[changed]
        if n > 500:
            near.append(r.near_edited)
            apart.append(r.near_next)
    assert len(set(by_text.values())) > 0.97 * len(by_text)
    # A half that stays is seen; a neighbour in the order is no relative.
    assert sum(near) / len(near) > 2 * sum(apart) / len(apart)


def test_small_edits_stay_near(spark):
    rng = random.Random(8)
    texts = [t for t in pd.read_parquet(f"{SF}/documents.parquet").text if 1500 < len(t) < 6000][:150]
    changed = []
    for t in texts:
        w = t.split(" ")
        for _ in range(max(1, len(w) // 100)):
            w[rng.randrange(len(w))] = "changedword"
        changed.append(" ".join(w))
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    allowed = fingerprints.lexicon(table.select("text"))
    both = spark.createDataFrame(list(zip(texts, changed)), "a string, b string")
    both = fingerprints.with_hashes(fingerprints.with_hashes(both, "a", allowed, "x"), "b", allowed, "y")
    got = [r[0] for r in both.select(fingerprints.likeness(F.col("x"), F.col("y"))).collect()]
    assert sum(got) / len(got) > 0.8 and max(got) <= 1


def test_lexicon_band(spark):
    """Terms of more than a tenth of the texts, and of less than their share of incidences, are out."""
    texts = [f"common half{i % 5} tenth{i % 10} some{i % 40} lone{i}" for i in range(400)]
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    names = {r.h: r.w for r in table.select(F.explode(F.split("text", " ")).alias("w")).distinct().select("w", F.xxhash64("w").alias("h")).collect()}
    kept = {names[h] for h in fingerprints.lexicon(table, 0.1, 500)}
    assert kept == {f"tenth{i}" for i in range(10)} | {f"some{i}" for i in range(40)}
    assert len(fingerprints.lexicon(table, 1.0, 3)) <= 3


def test_fingerprints_of_repeated_rows_null_ids_one_row_and_nothing(spark, empty):
    table = [(5, "first text here"), (5, "first text here"), (None, "second"), (None, None), (9, ""), (9, None), (-2**63, "lowest of all")]
    got = fingerprints.fingerprints(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in got) == sorted((d is None, d or 0, len(t or "")) for d, t in table)
    lone = fingerprints.fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert [(r.edited_sha256, r.near_next, r.next_id) for r in lone] == [(brute.sha("abab"), 1.0, 1)]
    assert fingerprints.fingerprints(empty).collect() == []


def test_queries_are_registered():
    assert {"op11_fingerprints", "op12_collocations", "op13_spelling"} <= set(QUERIES)
