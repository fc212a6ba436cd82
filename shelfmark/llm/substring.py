"""Removing passages that an earlier document holds, by Rabin-Karp hashes.

Every window of ``size`` consecutive words has a rolling hash.  A window whose
words also start in a document with a smaller id marks its words; marked words
that touch merge into maximal intervals, which are removed.

Chunks are ranges of ids.  A chunk sends each hash it holds once, and learns
which of them an earlier range holds; within the range it finds the earlier
document itself.  So a passage in a third of all documents is sent once per
chunk.  Hashes have 64 bits, of which 56 and the bucket's own bits travel: for
ten thousand million windows about one pair of different windows is taken for equal.

Null texts have no words.  Rows that share an id are one document: they never
remove from each other.  A null id is later than every other, and two null ids
are not earlier than one another.  Texts of fewer words than a window keep all.
An empty table returns no rows.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import (
    ASKED, ANSWERED, asked, asked_table, blocks, bucket_count, buffers, chunk_count, distinct, held_before, marked, row_windows, text_bytes,
    window_hashes, word_bounds, word_hashes)

WINDOW = 13
WIDTH = 7
#: Quantiles of the ids between which ranges are cut evenly.
KNOTS = 64


def ranges(docs: DataFrame, n: int) -> tuple[Column, int]:
    """The number of a document's range of ids, growing with the id, and the number after the last.

    Null ids come after all others and are spread over as many chunks again.
    """
    id_ = F.col("doc_id").cast("long")
    knots = docs.agg(F.percentile_approx(id_, [k / KNOTS for k in range(KNOTS + 1)], 10_000)).first()[0] or [0]
    knots = sorted(set(knots))
    each = -(-n // max(1, len(knots) - 1))
    out = F.lit((len(knots) + 1) * each - 1)
    for k in reversed(range(len(knots) - 1)):
        part = F.floor((id_ - knots[k]) / float(knots[k + 1] - knots[k]) * each)
        part = F.greatest(F.least(part, F.lit(each - 1)), F.lit(0))
        out = F.when(id_ < knots[k + 1], part + (k + 1) * each).otherwise(out)
    out = F.when(id_ < knots[0], F.lit(each - 1)).otherwise(out)
    last = (len(knots) + 1) * each
    spread = F.pmod(F.xxhash64("text"), F.lit(n)) + last
    return F.when(id_.isNull(), spread).otherwise(out).cast("long"), last


def _hashes(table: pa.Table, size: int):
    """For each block of a chunk, ordered by id: rows, bytes, words and the hashes of windows with where they start."""
    order = np.argsort(table.column("doc_id").fill_null((1 << 63) - 1).to_numpy(), kind="stable")
    data, at = buffers(table.column("text").take(pa.array(order)))
    for first, last in blocks(at):
        part, edges = data[at[first]:at[last]], at[first:last + 1] - at[first]
        starts, ends, per_row = word_bounds(part, edges)
        where = row_windows(per_row, size)
        yield order[first:last], part, starts, ends, per_row, where, window_hashes(word_hashes(part, starts, ends), size)[where]


def removed(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, intervals (of word numbers, end exclusive) and kept text of every row."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    total = text_bytes(docs)
    n_buckets = bucket_count(total / 6)
    chunk, last = ranges(docs, chunk_count(total))
    parts = docs.withColumn("chunk", chunk)

    def ask(table: pa.Table) -> pa.Table:
        keys = distinct(np.concatenate([h for *_, h in _hashes(table, size)] or [np.zeros(0, np.uint64)]))
        return asked_table(asked(table.column("chunk")[0].as_py(), keys, n_buckets, WIDTH))

    answers = parts.groupBy("chunk").applyInArrow(ask, ASKED).groupBy("bucket").applyInArrow(held_before(WIDTH, last), ANSWERED)

    def settle(table: pa.Table, answers: pa.Table) -> pa.Table:
        ids = table.column("doc_id").fill_null((1 << 63) - 1).to_numpy()
        read = list(_hashes(table, size))
        every = np.concatenate([h for *_, h in read] or [np.zeros(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = every[order][1:] != every[order][:-1]
        keys = every[order][new]
        group = np.cumsum(new) - 1
        of = np.concatenate([ids[rows][np.searchsorted(per_row, where, "right") - 1] for rows, *_, per_row, where, _ in read]
                            or [np.zeros(0, np.int64)])
        gone = np.zeros(len(order), bool)
        gone[order] = marked(keys, n_buckets, answers)[group] | (of[order] > of[order][new][group])
        out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "intervals": [], "kept": []}
        done, known = 0, table.column("doc_id").to_pylist()
        for rows, part, starts, ends, per_row, where, h in read:
            edge = np.zeros(len(starts) + size + 1, np.int64)
            hit = where[gone[done:done + len(h)]]
            done += len(h)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + size, -1)
            cut = np.cumsum(edge)[:len(starts)] > 0
            sizes = np.where(cut, 0, ends - starts + 1)
            ends_at = np.cumsum(sizes)
            index = np.arange(int(ends_at[-1]) if len(ends_at) else 0) - np.repeat(ends_at - sizes, sizes)
            source = index + np.repeat(starts, sizes)
            text = np.full(len(index), 32, np.uint8)
            inside = index < np.repeat(sizes - 1, sizes)
            text[inside] = part[source[inside]]
            ends_at = np.concatenate(([0], ends_at))
            for k, row in enumerate(rows.tolist()):
                a, b = int(per_row[k]), int(per_row[k + 1])
                here = np.flatnonzero(np.diff(np.concatenate(([0], cut[a:b].astype(np.int8), [0])))).tolist()
                out["doc_id"].append(known[row])
                out["n_words"].append(b - a)
                out["n_removed"].append(int(cut[a:b].sum()))
                out["intervals"].append([{"start": x, "end": y} for x, y in zip(here[::2], here[1::2], strict=True)])
                out["kept"].append(text[ends_at[a]:max(ends_at[a], ends_at[b] - 1)].tobytes())
        return pa.table([
            pa.array(out["doc_id"], pa.int64()), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()),
            pa.array(out["intervals"], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            pa.array(out["kept"], pa.binary()).cast(pa.string())], names=list(out))

    return parts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        settle, "doc_id long, n_words long, n_removed long, intervals array<struct<start:int,end:int>>, kept string")


def substring(docs: DataFrame) -> DataFrame:
    """One row per document: words, words removed, digest of what is kept, and removed runs."""
    return removed(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("intervals").cast("long").alias("n_spans"))
