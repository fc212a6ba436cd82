"""Language-model scores by context-tree weighting over bytes.

A byte is coded as eight binary choices, each a node named by the bits chosen
before it.  For every node and every context of the last 0..DEPTH bytes there
is a Krichevsky-Trofimov estimate; the weighted probability of a context is half its own
estimate's and half the product of its children's (contexts one byte longer), so
the mixture covers all depths and no depth has to be chosen.  After
training, the share of a context's weight that stops at it mixes its estimate
with the deeper ones when a text is scored.

The text is coded as the contract's tokens: lower-cased words, a blank after
each, a line feed as the end.  Training counts (DEPTH + 1)-byte strings of all
training texts; each map task adds up its own first, then strings with the same
last two context bytes meet, where that whole subtree is built.  The two
shallowest depths are built from subtree totals, of which the alphabet allows
65 536.  What scoring needs of a node (estimate and weight) is one entry of a
table of SLOTS entries, however much text was read: the node seen most often
takes the entry.  That table is broadcast (64 MB).  Where a context has no
entry, the deepest one that has decides.  Every bit's two probabilities add up
to one whatever the entries hold.

Word counts meet like keys of any other kind: a chunk asks each of its words once.

Null texts are empty: one token, the end.  A null id counts as an empty one for
the split.  With nothing to train on, every bit has probability one half.
Repeated rows count every time.  An empty table returns no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import (
    ASKED, BLOCK, asked, blocks, bucket_bounds, bucket_count, buffers, chunk_count, dealt, lower_bytes, mixed, stored, text_bytes,
    unpacked, word_bounds, word_hashes)

DEPTH = 5
SLOTS = 1 << 24
#: Parts in which the table is put together.
PARTS = 64
#: Times a node must have been seen to be scored with.
LEAST = 2
#: Strings whose probability a task remembers.
REMEMBERED = 1 << 21
WIDTH = 7
END = 10
_TOP = 9.5


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2


# --- text as a line of bytes -------------------------------------------------

def line(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Bytes to code, with DEPTH ends before each text; the coded positions; where each text's begin; its words."""
    data = lower_bytes(data)
    starts, ends, per_row = word_bounds(data, at)
    counts, sizes = np.diff(per_row), ends - starts + 1
    total = np.concatenate(([0], np.cumsum(sizes)))
    coded = np.where(counts > 0, total[per_row[1:]] - total[per_row[:-1]], 1)
    row_at = np.concatenate(([0], np.cumsum(coded + DEPTH)))
    out = np.full(int(row_at[-1]), 32, np.uint8)
    begin = np.repeat(row_at[:-1] + DEPTH - total[per_row[:-1]], counts) + total[:-1]
    index = np.arange(int((sizes - 1).sum())) - np.repeat(total[:-1] - np.arange(len(sizes)), sizes - 1)
    out[index + np.repeat(begin, sizes - 1)] = data[index + np.repeat(starts, sizes - 1)]
    out[row_at[1:] - 1] = END
    for k in range(DEPTH):
        out[row_at[:-1] + k] = END
    coded_at = np.concatenate(([0], np.cumsum(coded)))
    where = np.arange(int(coded_at[-1])) + np.repeat(DEPTH * np.arange(1, len(coded) + 1), coded)
    return out, where, coded_at, (starts, ends, per_row, data)


def strings(out: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The byte at each position with its context: symbol lowest, then one byte back and so on."""
    g = out[where].astype(np.uint64)
    for k in range(1, DEPTH + 1):
        g |= out[where - k].astype(np.uint64) << np.uint64(8 * k)
    return g


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts[order], first)


# --- the tree ----------------------------------------------------------------

def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 1/2 (Stirling's series after six steps up)."""
    low = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5)
    y = x + 6
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - np.log(low)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability that the estimator gives any sequence with these counts."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - 1.1447298858494002  # log(pi)


def nodes_of(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Binary nodes (context above, bits so far below) of strings, with how often a 0 and a 1 followed."""
    symbol, context = grams & np.uint64(255), grams & ~np.uint64(255)
    keys, ones = [], []
    for k in range(8):
        keys.append(context | np.uint64(1 << k) | (symbol >> np.uint64(8 - k)))
        ones.append(counts * ((symbol >> np.uint64(7 - k)) & np.uint64(1)).astype(np.int64))
    node, both = np.concatenate(keys), np.tile(counts, 8)
    order = np.argsort(node)
    node = node[order]
    first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    n1 = np.add.reduceat(np.concatenate(ones)[order], first)
    return node[first], np.add.reduceat(both[order], first) - n1, n1


def weighted(key: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: tuple[np.ndarray, np.ndarray] | None,
             depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Log weighted probability of nodes and the share of it that stops here; ``below``: the next depth's keys and logs."""
    own = log_kt(n0.astype(float), n1.astype(float))
    if below is None:
        return own, np.ones(len(own))
    parent = below[0] & np.uint64((1 << 8 * (depth + 1)) - 1)
    deeper = np.bincount(np.searchsorted(key, parent), weights=below[1], minlength=len(key))
    half = np.log(0.5)
    log = np.logaddexp(half + own, half + deeper)
    return log, np.exp(half + own - log)


def entries(depth: int, key: np.ndarray, n0: np.ndarray, n1: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """(place in the table and entry; times seen) of nodes seen often enough, as rows of two numbers."""
    seen = n0 + n1
    ok = seen >= LEAST
    h = mixed(key[ok] + np.uint64((depth + 1) << 56))
    p = (n1[ok] + 0.5) / (seen[ok] + 1.0)
    logit = np.clip(np.log(p / (1 - p)), -_TOP, _TOP)
    code = np.round((logit + _TOP) / (2 * _TOP) * 16383).astype(np.uint64)
    share = np.round(stop[ok] * 1023).astype(np.uint64)
    tag = (h & np.uint64(127)) + np.uint64(128)  # never an empty entry
    entry = tag << np.uint64(24) | code << np.uint64(10) | share
    slot = h >> np.uint64(64 - (SLOTS.bit_length() - 1))
    return np.stack((slot << np.uint64(32) | entry, seen[ok].astype(np.uint64)))


NODES = "part int, entries binary"


def _by_part(found: np.ndarray) -> list[tuple[int, bytes]]:
    order = np.argsort(found[0])
    found = found[:, order]
    each = SLOTS // PARTS
    edges = np.searchsorted(found[0] >> np.uint64(32), np.arange(PARTS + 1, dtype=np.uint64) * np.uint64(each))
    return [(k, found[:, a:b].tobytes()) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]


def _rows(kind: list[int], group: list[int], blobs: list[bytes]) -> pa.Table:
    return pa.table({"kind": pa.array(kind, pa.int32()), "part": pa.array(group, pa.int32()), "entries": pa.array(blobs, pa.binary())})


ROWS = "kind int, part int, entries binary"


def _subtree(table: pa.Table) -> pa.Table:
    """Depths 2 and more below one pair of last bytes: table entries (kind 0) and the depth 2 nodes (kind 1)."""
    blobs = [np.frombuffer(b, np.uint64).reshape(2, -1) for b in table.column("counts").to_pylist()]
    every = np.concatenate(blobs, axis=1)
    grams, counts = summed(every[0], every[1].astype(np.int64))
    below, found, top = None, [], b""
    for depth in range(DEPTH, 1, -1):
        if depth < DEPTH:
            grams, counts = summed(grams & np.uint64((1 << 8 * (depth + 1)) - 1), counts)
        key, n0, n1 = nodes_of(grams, counts)
        log, stop = weighted(key, n0, n1, below, depth)
        found.append(entries(depth, key, n0, n1, stop))
        below = key, log
        if depth == 2:
            top = np.stack((key, n0.astype(np.uint64), n1.astype(np.uint64), log.view(np.uint64))).tobytes()
    parts = _by_part(np.concatenate(found, axis=1))
    return _rows([0] * len(parts) + [1], [k for k, _ in parts] + [0], [b for _, b in parts] + [top])


def _crown(table: pa.Table) -> pa.Table:
    """Depths 1 and 0 from all depth 2 nodes (65 536 contexts of 255 nodes at most)."""
    blobs = [np.frombuffer(b, np.uint64).reshape(4, -1) for b in table.column("entries").to_pylist()]
    key, n0, n1, log = np.concatenate(blobs, axis=1)
    n0, n1, log, found = n0.astype(np.int64), n1.astype(np.int64), log.view(np.float64), []
    for depth in (1, 0):
        short = key & np.uint64((1 << 8 * (depth + 1)) - 1)
        node, a = summed(short, n0)
        _, b = summed(short, n1)
        new, stop = weighted(node, a, b, (key, log), depth)
        found.append(entries(depth, node, a, b, stop))
        key, n0, n1, log = node, a, b, new
    parts = _by_part(np.concatenate(found, axis=1))
    return _rows([0] * len(parts), [k for k, _ in parts], [b for _, b in parts])


def _assembled(table: pa.Table) -> pa.Table:
    """One part of the table: where nodes share a place, the one seen most often has it."""
    part, each = table.column("part")[0].as_py(), SLOTS // PARTS
    every = np.concatenate([np.frombuffer(b, np.uint64).reshape(2, -1) for b in table.column("entries").to_pylist()], axis=1)
    every = every[:, np.lexsort((every[0], every[1]))]  # ties fall the same way in every run
    out = np.zeros(each, np.uint32)
    out[(every[0] >> np.uint64(32)).astype(np.int64) - part * each] = every[0].astype(np.uint32)
    return pa.table({"part": pa.array([part], pa.int32()), "entries": pa.array([out.tobytes()], pa.binary())})


def trained(docs: DataFrame) -> np.ndarray:
    """The table of a tree grown on ``docs`` (doc_id, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            return [summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))] if held else []

        for batch in batches:
            data, at = buffers(batch.column(0))
            for first, last in blocks(at, 4 * BLOCK):
                out, where, _, _ = line(data[at[first]:at[last]], at[first:last + 1] - at[first])
                held.append(np.unique(strings(out, where), return_counts=True))
                if len(held) > 8 and sum(len(k) for k, _ in held[1:]) > max(2_000_000, len(held[0][0])):
                    held[:] = merged()
        for keys, counts in merged():
            tail = (keys >> np.uint64(8)) & np.uint64(0xFFFF)
            order = np.argsort(tail, kind="stable")
            keys, counts, tail = keys[order], counts[order], tail[order]
            at = np.flatnonzero(np.concatenate(([True], tail[1:] != tail[:-1], [True])))
            yield pa.RecordBatch.from_arrays([
                pa.array(tail[at[:-1]].astype(np.int32)),
                pa.array([np.stack((keys[a:b], counts[a:b].astype(np.uint64))).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)],
                         pa.binary())], names=["tail", "counts"])

    trees = stored(docs.select("text").mapInArrow(count, "tail int, counts binary").groupBy("tail").applyInArrow(_subtree, ROWS), "trees")
    crown = trees.filter("kind = 1").groupBy("kind").applyInArrow(_crown, ROWS)
    parts = trees.filter("kind = 0").unionByName(crown).select("part", "entries").groupBy("part").applyInArrow(_assembled, NODES)
    out = np.zeros(SLOTS, np.uint32)
    for row in parts.toLocalIterator():  # PARTS rows of one size
        each = SLOTS // PARTS
        out[row["part"] * each:(row["part"] + 1) * each] = np.frombuffer(row["entries"], np.uint32)
    return out


def log10_probability(table: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Log10 of the probability of each string's last byte after its context."""
    symbol, out = grams & np.uint64(255), np.zeros(len(grams))
    context = [grams & np.uint64(((1 << 8 * (d + 1)) - 1) & ~255) for d in range(DEPTH + 1)]
    bits = np.uint64(64 - (SLOTS.bit_length() - 1))
    for k in range(8):
        node = np.uint64(1 << k) | (symbol >> np.uint64(8 - k))
        q, rest, p, alive = np.zeros(len(grams)), np.ones(len(grams)), np.full(len(grams), 0.5), np.ones(len(grams), bool)
        for d in range(DEPTH + 1):
            h = mixed((context[d] | node) + np.uint64((d + 1) << 56))
            entry = table[h >> bits]
            alive = alive & ((entry >> np.uint32(24)) == ((h & np.uint64(127)) + np.uint64(128)).astype(np.uint32))
            logit = ((entry >> np.uint32(10)) & np.uint32(16383)) * (2 * _TOP / 16383) - _TOP
            p = np.where(alive, 1 / (1 + np.exp(-logit)), p)
            share = np.where(alive, (entry & np.uint32(1023)) / 1023.0, 0.0)
            q += rest * share * p
            rest *= 1 - share
        q += rest * p
        one = (symbol >> np.uint64(7 - k)) & np.uint64(1)
        out += np.log10(np.where(one == 1, q, 1 - q))
    return out


class Scorer:
    """Scores of texts under a table; strings met before are remembered."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table
        self.known, self.value = np.full(REMEMBERED, np.iinfo(np.uint64).max, np.uint64), np.zeros(REMEMBERED)

    def of(self, grams: np.ndarray) -> np.ndarray:
        place = mixed(grams) >> np.uint64(64 - (REMEMBERED.bit_length() - 1))
        new = self.known[place] != grams
        out = self.value[place]
        if new.any():
            missing, inverse = np.unique(grams[new], return_inverse=True)
            value = log10_probability(self.table, missing)
            out[new] = value[inverse]
            at = mixed(missing) >> np.uint64(64 - (REMEMBERED.bit_length() - 1))
            # One string per place, the last: written together, so the pair belongs together.
            _, last = np.unique(at[::-1], return_index=True)
            pick = len(at) - 1 - last
            self.known[at[pick]], self.value[at[pick]] = missing[pick], value[pick]
        return out


# --- words -------------------------------------------------------------------

COUNTED = "chunk long, bucket int, counts binary"


def _end_hash() -> np.uint64:
    return mixed(np.array([0x0E0D], np.uint64))[0]


def _chunk_words(table: pa.Table):
    """For each block: rows, tokens' hashes (words, then one end per row) and where each row's tokens begin; the coded line."""
    data, at = buffers(table.column("text"))
    for first, last in blocks(at):
        out, where, coded_at, (starts, ends, per_row, low) = line(data[at[first]:at[last]], at[first:last + 1] - at[first])
        h = word_hashes(low, starts, ends)
        yield first, last, np.insert(h, per_row[1:], _end_hash()), per_row + np.arange(len(per_row)), (out, where, coded_at)


def scores(docs: DataFrame) -> DataFrame:
    """One row per document: split, tokens, known tokens, base score and model score."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text", held_out().alias("held_out"))
    table = spark.sparkContext.broadcast(trained(docs.filter(~F.col("held_out"))))
    total = text_bytes(docs)
    # About one distinct word in five of a chunk's.
    n_buckets = bucket_count(total / 30)
    parts = dealt(docs, chunk_count(total))
    scorers: list[Scorer] = []  # each task has its own, for all its chunks

    def ask(table: pa.Table) -> pa.Table:
        held = table.column("held_out").to_numpy(zero_copy_only=False)
        keys, train = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for first, last, h, begin, _ in _chunk_words(table):
            keys.append(h)
            train.append(np.repeat((~held[first:last]).astype(np.int64), np.diff(begin)))
        keys, counts = summed(np.concatenate(keys), np.concatenate(train))
        rows = asked(table.column("chunk")[0].as_py(), keys, n_buckets, WIDTH)
        at = bucket_bounds(keys, n_buckets)
        # Counts travel behind the keys.
        rows["keys"] = [k + counts[at[b]:at[b + 1]].astype("<u4").tobytes() for b, k in zip(rows["bucket"], rows["keys"], strict=True)]
        return pa.table({"bucket": pa.array(rows["bucket"], pa.int32()), "chunk": pa.array(rows["chunk"], pa.int64()),
                         "keys": pa.array(rows["keys"], pa.binary())})

    def read(blobs: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        n = [len(b) // (WIDTH + 4) for b in blobs]
        keys = [unpacked(b[:k * WIDTH], WIDTH) for b, k in zip(blobs, n, strict=True)]
        counts = np.concatenate([np.frombuffer(b, "<u4", k, k * WIDTH) for b, k in zip(blobs, n, strict=True)]).astype(np.int64)
        return keys, *summed(np.concatenate(keys), counts)

    def add_up(table: pa.Table) -> pa.Table:
        keys, all_keys, sums = read(table.column("keys").to_pylist())
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "counts": pa.array(
            [sums[np.searchsorted(all_keys, k)].astype("<i8").tobytes() for k in keys], pa.binary())})

    def totals(table: pa.Table) -> pa.Table:
        _, _, sums = read(table.column("keys").to_pylist())
        return pa.table({"n": pa.array([int(sums.sum())], pa.int64()), "v": pa.array([int((sums > 0).sum())], pa.int64())})

    def settle(docs_: pa.Table, answers: pa.Table) -> pa.Table:
        if not scorers:
            scorers.append(Scorer(table.value))
        scorer, read_ = scorers[0], list(_chunk_words(docs_))
        keys = np.unique(np.concatenate([h for _, _, h, _, _ in read_])) if read_ else np.zeros(0, np.uint64)
        at, counts = bucket_bounds(keys, n_buckets), np.zeros(len(keys), np.int64)
        for b, blob in zip(answers.column("bucket").to_pylist(), answers.column("counts").to_pylist(), strict=True):
            counts[at[b]:at[b + 1]] = np.frombuffer(blob, "<i8")
        out: list[list] = [[], [], [], []]
        for _, _, h, begin, (text, where, coded_at) in read_:
            c = counts[np.searchsorted(keys, h)]
            known = np.concatenate(([0], np.cumsum(c > 0)))
            out[0] += np.diff(begin).tolist()
            out[1] += (known[begin[1:]] - known[begin[:-1]]).tolist()
            out[2] += np.add.reduceat(np.log10(c + 1.0), begin[:-1]).tolist()
            out[3] += np.add.reduceat(scorer.of(strings(text, where)), coded_at[:-1]).tolist()
        return pa.table([docs_.column("doc_id"), docs_.column("held_out"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                         pa.array(out[2], pa.float64()), pa.array(out[3], pa.float64())],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "logs", "score"])

    requests = parts.groupBy("chunk").applyInArrow(ask, ASKED)
    answers = requests.groupBy("bucket").applyInArrow(add_up, COUNTED)
    whole = requests.groupBy("bucket").applyInArrow(totals, "n long, v long").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("train_tokens"), F.coalesce(F.sum("v"), F.lit(0)).alias("_v"))
    rows = parts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        settle, "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double")
    # One row of two sums stands beside every row.
    base = F.col("logs") - F.col("n_tokens") * F.log10((F.col("train_tokens") + F.col("_v") + 1).cast("double"))
    return rows.crossJoin(F.broadcast(whole)).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", base.alias("base_score"), "score")
