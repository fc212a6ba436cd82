"""Spelling variants: words one edit apart, grouped under the far more frequent one.

Words are arranged in a trie by how often they hold each letter group: level by
level the counts of 'e', 't', 'a', ... and of the groups of all other letters.
An edit changes these counts by little: an inserted letter is a surplus of one,
a deleted one a deficit of one, a replaced one a surplus and a deficit.  So a
search goes down the trie with a budget of one surplus and one deficit and
ends in the leaves that may hold neighbours; their words are verified letter by
letter.

Each pair is looked for from one side only: the search must use its surplus
before its deficit, which of two words of one length is true for one of them, and
an inserted letter is found from the shorter word.

The trie is cut below its first levels (length and the counts of ``ROUTED``).
A word lies in one such part and asks in the few others that its budget
reaches, so a part is one task's work and no part depends on how frequent a
word is: every word is there once, with its number.  A part is searched for
blocks of distinct count vectors, level by level.

Null and empty texts have no words.  Repeated rows count as often as they
occur.  A null id is written as the empty string.  An empty table gives no rows.  Only the columns
``doc_id`` and ``text`` are looked at, whatever others are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import ascii_lower, stored

#: What a word is made of, and which occurrences lose a letter.
RUN = "[A-Za-zÀ-ÿ]+"
TYPO_EVERY = 31
#: Shortest and rarest words that are grouped, and how much more frequent a form is.
LEAST_LENGTH, LEAST_COUNT, FORM_TIMES = 7, 2, 10
#: Levels of the trie: one letter each, then groups of all other letters.
LETTERS = "etaoinshrdlcumwfgypbvkjxqz"
OTHERS = 6
LEVELS = len(LETTERS) + OTHERS
#: Letters whose counts (after the length) say in which part of the trie a word lies.
ROUTED = 3
#: Distinct count vectors searched together, and bytes of word pairs verified together.
SEARCHED, VERIFIED = 4096, 1 << 24

_GROUP = np.array([LETTERS.find(chr(c)) if chr(c) in LETTERS else len(LETTERS) + c % OTHERS for c in range(256)], np.int64)


def occurrences(docs: DataFrame) -> DataFrame:
    """Every word occurrence that is long enough, its letter deleted where the rule says so."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col("text"), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= LEAST_LENGTH).withColumn("run", ascii_lower(F.col("run")))
    h = F.crc32(F.concat_ws(":", "id", "run"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % TYPO_EVERY == 0, less).otherwise(F.col("run"))
    return runs.withColumn("h", h).select(word.alias("word")).filter(F.length("word") >= LEAST_LENGTH)


def vocabulary(docs: DataFrame) -> DataFrame:
    """Distinct words with their number of occurrences (n)."""
    return occurrences(docs).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


# --- parts of the trie ----------------------------------------------------

PART = ["size", *[f"c{k}" for k in range(ROUTED)]]


def _place(more: int, change: dict[int, int], asks: bool) -> Column:
    counts = [F.col(f"_{k}") + change.get(k, 0) for k in range(ROUTED)]
    fields = [(F.col("_size") + more).alias("size"), *[c.alias(f"c{k}") for k, c in enumerate(counts)], F.lit(asks).alias("asks")]
    place = F.struct(*fields)
    fewer = [k for k, d in change.items() if d < 0]
    return F.when(F.col(f"_{fewer[0]}") > 0, place) if fewer else place


def routed(words: DataFrame) -> DataFrame:
    """``words`` once in their own part and once (``asks``) in each other part that the budget reaches."""
    words = words.withColumns({"_size": F.length("word"), **{
        f"_{k}": F.length("word") - F.length(F.translate("word", LETTERS[k], "")) for k in range(ROUTED)}})
    places = [_place(0, {}, False)]
    places += [_place(0, {k: 1}, True) for k in range(ROUTED)]
    places += [_place(0, {k: 1, j: -1}, True) for k in range(ROUTED) for j in range(k + 1, ROUTED)]
    places += [_place(1, {}, True)] + [_place(1, {k: 1}, True) for k in range(ROUTED)]
    return words.select("word", "n", F.explode(F.array_compact(F.array(*places))).alias("p")).select("p.*", "word", "n")


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, and where each word starts (one more at the end)."""
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
    return points, np.concatenate(([0], np.cumsum(sizes)))


def _vectors(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often each word holds each letter group."""
    group = np.where(points < 256, _GROUP[np.minimum(points, 255)], len(LETTERS) + points.astype(np.int64) % OTHERS)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return np.bincount(row * LEVELS + group, minlength=(len(at) - 1) * LEVELS).reshape(-1, LEVELS)


def _distinct_vectors(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct vectors, the words in their order, and where each vector's words start."""
    order = np.lexsort(vectors.T[::-1])
    rows = vectors[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    first = np.flatnonzero(new)
    return rows[first], order, np.append(first, len(rows))


class Trie:
    """Sorted vectors as a trie: on each level the (parent, count) of every node, in order."""

    def __init__(self, vectors: np.ndarray):
        self.width = int(vectors.max(initial=0)) + 2
        self.levels = []
        parent = np.zeros(len(vectors), np.int64)
        for k in range(vectors.shape[1]):
            keys = parent * self.width + vectors[:, k]
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            self.levels.append(keys[new])
            parent = np.cumsum(new) - 1

    def child(self, level: int, nodes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The child of each node with this count, or -1."""
        keys = self.levels[level]
        asked = nodes * self.width + counts
        found = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return np.where((keys[found] == asked) & (counts >= 0) & (counts < self.width), found, -1)

    def search(self, vectors: np.ndarray, deficit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vector, leaf, state) within the budget; state: 0 nothing used, 1 the surplus, 2 the surplus, then the deficit.

        ``deficit``: which of the vectors may use a deficit, too.
        """
        who, node = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
        state = np.zeros(len(vectors), np.int8)
        for level in range(vectors.shape[1]):
            count = vectors[who, level]
            steps = [(np.arange(len(who)), 0, state)]
            fresh, spent = np.flatnonzero(state == 0), np.flatnonzero((state == 1) & deficit[who])
            steps += [(fresh, 1, np.ones(len(fresh), np.int8)), (spent, -1, np.full(len(spent), 2, np.int8))]
            parts = []
            for rows, change, then in steps:
                to = self.child(level, node[rows], count[rows] + change)
                ok = to >= 0
                parts.append((who[rows[ok]], to[ok], then[ok]))
            who, node, state = (np.concatenate(x) for x in zip(*parts, strict=True))
        return who, node, state


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that start at ``starts``, one after another."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _matrix(points: np.ndarray, at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    return points[at[rows][:, None] + np.arange(size)]


def _one_edit(points: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray, size: int, longer: int) -> np.ndarray:
    """Whether words ``a`` (of this size) and ``b`` (as long, or longer by one) are exactly one edit apart."""
    x, y = _matrix(points, at, a, size), _matrix(points, at, b, size + longer)
    if not longer:
        return (x != y).sum(axis=1) == 1
    ahead, behind = x != y[:, :size], x != y[:, 1:]
    prefix = np.where(ahead.any(axis=1), ahead.argmax(axis=1), size)
    suffix = np.where(behind.any(axis=1), behind[:, ::-1].argmax(axis=1), size)
    return prefix + suffix >= size


def _pairs(points: np.ndarray, at: np.ndarray, asks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a part that are near each other: (asking, stored), every pair once."""
    stored_rows = np.flatnonzero(~asks)
    size = int(at[stored_rows[0] + 1] - at[stored_rows[0]])
    vectors = _vectors(points, at)
    leaves, order, leaf_at = _distinct_vectors(vectors[stored_rows])
    leaf_rows = stored_rows[order]
    trie = Trie(leaves)
    queries, query_rows, query_at = _distinct_vectors(vectors)
    same = queries.sum(axis=1) == size
    for first in range(0, len(queries), SEARCHED):
        who, leaf, state = trie.search(queries[first:first + SEARCHED], same[first:first + SEARCHED])
        who = who + first
        right = np.where(same[who], state != 1, state == 1)
        who, leaf, state = who[right], leaf[right], state[right]
        for longer in (0, 1):
            pick = (state == 1) == bool(longer)
            w, f = who[pick], leaf[pick]
            n = query_at[w + 1] - query_at[w]
            rows, f = query_rows[_ranges(query_at[w], n)], np.repeat(f, n)
            n = leaf_at[f + 1] - leaf_at[f]
            ends = np.cumsum(n)
            most = max(1, VERIFIED // (4 * max(1, size)))
            begin = 0
            while begin < len(n):
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, "right")))
                a, b = np.repeat(rows[begin:end], n[begin:end]), leaf_rows[_ranges(leaf_at[f[begin:end]], n[begin:end])]
                if not longer:  # words of one vector stand in one part: each two of them once
                    keep = (vectors[a] != vectors[b]).any(axis=1) | (a < b)
                    a, b = a[keep], b[keep]
                near = _one_edit(points, at, a, b, size - longer, longer)
                yield a[near], b[near]
                begin = end


NEAR = "word string, n_near long, best_n long, best string"


def _searched(table: pa.Table) -> pa.Table:
    """For words of a part: how many near words were found here, and the best of them."""
    table = table.combine_chunks()
    words, n = table.column("word").combine_chunks(), table.column("n").to_numpy()
    asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
    none = pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()),
                     "best_n": pa.array([], pa.int64()), "best": pa.array([], pa.string())})
    if asks.all():
        return none
    points, at = _letters(words)
    alphabetic = np.empty(len(words), np.int64)
    alphabetic[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
    by_rank = np.lexsort((alphabetic, -n))
    rank = np.empty(len(words), np.int64)
    rank[by_rank] = np.arange(len(words))
    count, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)
    for a, b in _pairs(points, at, asks):
        for x, y in ((a, b), (b, a)):
            count += np.bincount(x, minlength=len(words))
            np.minimum.at(best, x, rank[y])
    found = np.flatnonzero(count)
    if len(found) == 0:
        return none
    top = by_rank[best[found]]
    return pa.table({"word": words.take(pa.array(found)), "n_near": pa.array(count[found]), "best_n": pa.array(n[top]),
                     "best": words.take(pa.array(top))})


# --- forms and roots ------------------------------------------------------

def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near and the near word of largest n (ties: the smallest word) of all words that have one."""
    found = routed(words).groupBy(*PART).applyInArrow(_searched, NEAR)
    return found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("top"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms followed to their last.

    A form is at least ten times as frequent as its word, so chains are short; each
    round doubles how far is followed.
    """
    current = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = stored(current.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        current = new.select("word", "root")
        if new.filter("moved").isEmpty():
            return current


def grouped(words: DataFrame) -> DataFrame:
    """``words`` (word, n; every word once) with form, root, n_near and form_n."""
    near = neighbours(words).withColumns({"best": F.col("top.word"), "best_n": -F.col("top.less")}).drop("top")
    rows = words.join(near, "word", "left")
    accepted = F.col("best_n") >= FORM_TIMES * F.col("n")
    rows = stored(rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(accepted, F.col("best")).alias("form"), F.when(accepted, F.col("best_n")).alias("form_n")), "forms")
    followed = roots(rows.filter("form is not null"))
    return rows.join(followed, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame) -> DataFrame:
    """One row per word of ``docs``: its form, root, frequency and number of near words."""
    return grouped(stored(vocabulary(docs), "vocabulary"))
