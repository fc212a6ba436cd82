"""Removing byte strings that occur twice, by blockwise suffix sorting with a difference cover.

A suffix matters here by its first ``size`` bytes.  Positions whose number in
their document falls on a difference cover modulo v are the *cover sample*:
for any two positions there is a shift below v that takes both onto the
cover, so two equal strings share a pair of sample suffixes.

1. The sample is sorted by its leading bytes, one bucket at a time, and each
   sample suffix learns whether its leading bytes occur again.
2. A position stays open if the cover allows it: some shift onto the cover
   must meet sample suffixes that recur, at every step of v inside the string.
   All other suffixes have no equal and are never sorted.
3. Open suffixes are sorted one bucket at a time; the order inside a bucket
   is that of fingerprints of the leading ``size`` bytes, which puts equal
   strings next to each other; the alphabet's order is not needed for that.
   Long runs of open suffixes between two content-chosen anchors travel as one
   key (the fingerprint of the whole stretch): if that stretch recurs, so does
   every string in it, and only the first chunk that holds it sends its suffixes
   on behalf of all.  The other open suffixes travel one by one.

Buckets split the key space evenly and grow in number with the input, so a
task holds one bucket (about a million keys) whatever the input.  A chunk sends
a key once however often it holds it.

Null texts are empty.  Matches never cross documents and may overlap; rows with
equal texts (also with one id) match each other.  Texts shorter than ``size``
keep all bytes.  An empty table returns no rows.  Other columns are ignored.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import (
    _BYTE, ASKED, ANSWERED, asked, asked_table, blocks, bucket_count, buffers, chunk_count, dealt, distinct, held_elsewhere,
    mixed, powers, recurring, text_bytes)

SIZE = 400
PRIME = 13
#: Leading bytes by which the sample is sorted, and bytes of the keys that travel.
LEAD, SAMPLE_WIDTH, WIDTH = 100, 5, 7
#: Bytes an anchor is chosen by, and among how many neighbours.
ANCHOR, NEAR = 24, 64


@cache
def difference_cover(q: int = PRIME) -> tuple[int, tuple[int, ...]]:
    """v = q*q + q + 1 and q + 1 residues whose differences are all residues but 0, each once (q prime).

    Such a set exists that multiplication by q maps onto itself, so whole
    orbits of that map are tried.
    """
    v, orbits, seen = q * q + q + 1, [], set()
    for x in range(v):
        if x not in seen:
            orbit = [x]
            while (y := orbit[-1] * q % v) != x:
                orbit.append(y)
            seen.update(orbit)
            orbits.append(orbit)
    orbits.sort(key=len, reverse=True)

    def grow(at: int, chosen: list[int], used: set[int]):
        if len(chosen) == q + 1:
            return chosen
        for k in range(at, len(orbits)):
            if len(chosen) + len(orbits[k]) > q + 1:
                continue
            more, fresh, fine = list(chosen), set(used), True
            for x in orbits[k]:
                for y in more:
                    for d in ((x - y) % v, (y - x) % v):
                        fine &= d not in fresh
                        fresh.add(d)
                more.append(x)
            if fine and (found := grow(k + 1, more, fresh)):
                return found
        return None

    return v, tuple(sorted(grow(0, [], set())))


@cache
def _inverse() -> np.uint64:
    """The inverse of the hash base modulo 2**64."""
    return np.uint64(pow(int(powers(2)[1]), -1, 1 << 64))


_inverse_powers = np.ones(1, dtype=np.uint64)


def inverse_powers(n: int) -> np.ndarray:
    global _inverse_powers
    if len(_inverse_powers) < n:
        more = np.full(max(n, 2 * len(_inverse_powers), 4096), _inverse(), dtype=np.uint64)
        more[0] = 1
        _inverse_powers = np.multiply.accumulate(more)
    return _inverse_powers


class Block:
    """Some documents' bytes with fingerprints of any stretch of them."""

    def __init__(self, data: np.ndarray, at: np.ndarray, size: int) -> None:
        n = len(data)
        self.data, self.at, self.size = data, at, size
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers(n)[:n], out=self.sums[1:])
        self.lengths = np.diff(at)

    def prints(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Fingerprints of the bytes from ``start``, ``size`` of them."""
        sums = self.sums[start + size] - self.sums[start]
        return mixed(sums * inverse_powers(len(self.sums))[start] + np.asarray(size).astype(np.uint64))

    def sample(self) -> np.ndarray:
        """Positions of the cover sample that have LEAD bytes before the document's end."""
        v, residues = difference_cover()
        room = np.maximum(self.lengths - LEAD + 1, 0)
        longest = int(room.max(initial=0))
        steps = (np.arange(0, longest + v, v)[:, None] + np.array(residues)).ravel()
        counts = np.searchsorted(steps, room)
        index = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        return steps[index] + np.repeat(self.at[:-1], counts)

    def starts(self) -> np.ndarray:
        """Whether a string of ``size`` bytes that starts here ends inside its document."""
        edge = np.zeros(len(self.data) + 1, np.int8)
        has = self.lengths >= self.size
        np.add.at(edge, self.at[:-1][has], 1)
        np.add.at(edge, self.at[1:][has] - self.size + 1, -1)
        return np.cumsum(edge[:-1], dtype=np.int8) > 0

    def open(self, sample: np.ndarray, recurs: np.ndarray) -> np.ndarray:
        """Starts that the cover allows, given which sample suffixes recur."""
        v, _ = difference_cover()
        n, flag = len(self.data), np.zeros(len(self.data) + v, bool)
        flag[sample[recurs]] = True
        a = np.flatnonzero(flag[:n])
        near = self.size - LEAD - v  # up to this shift, the next step of v is inside the string too
        edge = np.zeros(n + 1, np.int32)
        low = np.maximum(a - v + 1, 0)
        both = flag[a + v]
        high = np.where(both, a + 1, np.maximum(a - near, 0))
        high = np.maximum(high, low)
        np.add.at(edge, low, 1)
        np.add.at(edge, high, -1)
        return (np.cumsum(edge[:-1]) > 0) & self.starts()

    def anchors(self) -> np.ndarray:
        """Content-chosen positions: the least hash of ANCHOR bytes among NEAR neighbours on either side."""
        n = len(self.data) - ANCHOR
        if n <= 0:
            return np.zeros(0, np.int64)
        h = self.prints(np.arange(n), ANCHOR)
        least = h.copy()
        step = 1
        while step < NEAR:  # running minimum over the next NEAR positions, by doubling
            least[:-step] = np.minimum(least[:-step], least[step:])
            step *= 2
        behind = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        behind[NEAR:] = least[:-NEAR]
        return np.flatnonzero((h == least) & (h <= behind))

    def stretches(self, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last start of stretches between neighbouring anchors whose starts are all open."""
        a = self.anchors()
        a = a[open_[a]]
        if len(a) < 2:
            return a[:0], a[:0]
        closed = np.concatenate(([0], np.cumsum(~open_)))
        x, y = a[:-1], a[1:]
        fine = closed[y + 1] == closed[x]
        return x[fine], y[fine]


def _between(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """True at the positions of some intervals, ends included."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + 1, -1)
    return np.cumsum(edge[:-1]) > 0


class Chunk:
    """A chunk's documents, taken through the rounds as far as answers have come."""

    def __init__(self, table: pa.Table, answers: pa.Table | None, rounds: int, plan: dict) -> None:
        # The same order in every round: which anchors are found depends on the neighbours.
        self.table = table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        data, at = buffers(table.column("text"))
        self.blocks = [Block(data[at[a]:at[b]], at[a:b + 1] - at[a], plan["size"]) for a, b in blocks(at)]
        self.keys: list[np.ndarray] = []
        come = lambda k: answers.filter(pc.equal(answers.column("round"), k))

        def flags(k: int) -> list[tuple[np.ndarray, np.ndarray]]:
            if not self.keys:
                return []
            at = np.cumsum([len(x) for x in self.keys])[:-1]
            again, earlier = recurring(np.concatenate(self.keys), plan["buckets"][k], come(k))
            return list(zip(np.split(again, at), np.split(earlier, at), strict=True))

        sample = [b.sample() for b in self.blocks]
        self.keys = [b.prints(s, LEAD) for b, s in zip(self.blocks, sample, strict=True)]
        if rounds == 0:
            return
        self.open = [b.open(s, r) for b, s, (r, _) in zip(self.blocks, sample, flags(0), strict=True)]
        self.stretches = [b.stretches(o) for b, o in zip(self.blocks, self.open, strict=True)]
        self.keys = [b.prints(x, y - x + plan["size"]) for b, (x, y) in zip(self.blocks, self.stretches, strict=True)]
        if rounds == 1:
            return
        self.again, left = [], []
        for b, o, (x, y), (r, earlier) in zip(self.blocks, self.open, self.stretches, flags(1), strict=True):
            self.again.append(_between(x[r], y[r], len(b.data)))
            # An earlier chunk holds these stretches as well and sends their strings for all.
            left.append(np.flatnonzero(o & ~_between(x[earlier], y[earlier], len(b.data))))
        self.keys = [b.prints(p, plan["size"]) for b, p in zip(self.blocks, left, strict=True)]
        if rounds == 2:
            return
        for again, p, (r, _) in zip(self.again, left, flags(2), strict=True):
            again[p[r]] = True

    def distinct(self) -> np.ndarray:
        return distinct(np.concatenate(self.keys or [np.zeros(0, np.uint64)]))


ROUND = "round int, chunk long, bucket int, marks binary"


def removed(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (byte offsets, end exclusive) and kept bytes of every row.

    ``size`` must leave room for a step of the cover: v + LEAD at least.
    """
    v, residues = difference_cover()
    if size < v + LEAD:
        raise ValueError(f"size must be {v + LEAD} or more")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    total = text_bytes(docs)
    parts = dealt(docs, chunk_count(total))
    # About one anchor in NEAR bytes, and open starts that travel at about a tenth of all.
    plan = {"size": size, "buckets": [bucket_count(total * len(residues) / v), bucket_count(total / NEAR), bucket_count(total / 10)]}
    widths = (SAMPLE_WIDTH, WIDTH, WIDTH)

    def ask(k: int):
        def first(table: pa.Table) -> pa.Table:
            return asked_table(asked(table.column("chunk")[0].as_py(), Chunk(table, None, 0, plan).distinct(), plan["buckets"][0], widths[0]))

        def later(table: pa.Table, answers: pa.Table) -> pa.Table:
            return asked_table(asked(table.column("chunk")[0].as_py(), Chunk(table, answers, k, plan).distinct(), plan["buckets"][k], widths[k]))

        return later if k else first

    answers = None
    for k in range(3):
        if answers is None:
            requests = parts.groupBy("chunk").applyInArrow(ask(k), ASKED)
        else:
            requests = parts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(ask(k), ASKED)
        come = requests.groupBy("bucket").applyInArrow(held_elsewhere(widths[k]), ANSWERED).select(
            F.lit(k).alias("round"), "chunk", "bucket", "marks")
        answers = come if answers is None else answers.unionByName(come)

    def settle(table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(table, answers, 3, plan)
        out: dict[str, list] = {"doc_id": chunk.table.column("doc_id").to_pylist(), "n_bytes": [], "n_removed": [], "spans": [], "kept": []}
        for b, again in zip(chunk.blocks, chunk.again, strict=True):
            edge = np.zeros(len(b.data) + size + 1, np.int32)
            edge[:len(again)] += again
            edge[size:size + len(again)] -= again
            gone = np.cumsum(edge)[:len(again)] > 0
            kept, before = b.data[~gone], np.concatenate(([0], np.cumsum(~gone)))
            for x, y in zip(b.at[:-1].tolist(), b.at[1:].tolist(), strict=True):
                here = np.flatnonzero(np.diff(np.concatenate(([0], gone[x:y].view(np.int8), [0])))).tolist()
                left = kept[before[x]:before[y]]
                out["n_bytes"].append(y - x)
                out["n_removed"].append(y - x - len(left))
                out["spans"].append([{"start": s, "end": e} for s, e in zip(here[::2], here[1::2], strict=True)])
                out["kept"].append(left.tobytes())
        return pa.table([
            pa.array(out["doc_id"], pa.int64()), pa.array(out["n_bytes"], pa.int64()), pa.array(out["n_removed"], pa.int64()),
            pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            pa.array(out["kept"], pa.binary())], names=list(out))

    return parts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        settle, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary")


def repeats(docs: DataFrame) -> DataFrame:
    """One row per document: bytes, bytes removed, removed runs, digest of what is kept."""
    return removed(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
