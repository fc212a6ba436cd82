"""BPE encoding and decoding by forced boundaries.

A pair of bytes that stands inside no vocabulary token can never be merged, so
the text is certain to be cut between them.  Every pre-token is cut at such
pairs and its fragments are encoded independently; their ids, one after
another, are the ids of the whole.  Fragments recur, so each task remembers
the ones it has encoded.

Nulls count as empty texts; an empty text has no ids.  The string of a special
token in a text is that token, as the vocabulary file says.  Very long texts
and pre-tokens work: merging takes n log n steps.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import quoted

#: How the vocabulary's authors split text before merging (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries that a task remembers before it starts anew: bounds memory only.
REMEMBERED = 400_000
LONGEST_REMEMBERED = 64
#: Texts that ``encoded`` has in hand at once.
ROWS = 500


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: itself if it is visible, else the next free one from 256."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, merges and forced boundaries of a byte-level vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        ids = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        inside = np.zeros((256, 256), dtype=bool)
        for token, i in ids.items():
            self.tokens[i] = b = raw(token)
            codes = np.frombuffer(b, np.uint8)
            inside[codes[:-1], codes[1:]] = True
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        #: True where two bytes stand inside no token.
        self.forced = ~inside
        self.byte_id = [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.split = regex.compile(SPLIT)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._known: dict[str, bytes] = {}
        self._fragments: dict[bytes, bytes] = {}

    def cuts(self, piece: bytes) -> list[bytes]:
        """The fragments of a pre-token between forced boundaries."""
        codes = np.frombuffer(piece, np.uint8)
        at = (np.flatnonzero(self.forced[codes[:-1], codes[1:]]) + 1).tolist()
        return [piece[a:b] for a, b in zip([0, *at], [*at, len(piece)], strict=True)]

    def merge(self, fragment: bytes) -> list[int]:
        """Merge the lowest-ranked pair, leftmost first, until none is left."""
        ids = [self.byte_id[b] for b in fragment]
        n = len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            if found := self.merges.get((ids[i], ids[i + 1])):
                heap.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged since
            ids[i], ids[j] = new, -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if found := self.merges.get((new, ids[k])):
                    heapq.heappush(heap, (found[0], i, new, ids[k], found[1]))
            if (h := left[i]) >= 0 and (found := self.merges.get((ids[h], new))):
                heapq.heappush(heap, (found[0], h, ids[h], new, found[1]))
        return [x for x in ids if x >= 0]

    def fragment(self, raw: bytes) -> bytes:
        """Ids of one of a pre-token's fragments, packed."""
        found = self._fragments.get(raw)
        if found is None:
            found = np.array(self.merge(raw), "<u4").tobytes()
            if len(raw) <= LONGEST_REMEMBERED:
                if len(self._fragments) >= REMEMBERED:
                    self._fragments.clear()
                self._fragments[raw] = found
        return found

    def piece(self, text: str) -> bytes:
        """Ids of one pre-token, packed."""
        fragments = self.cuts(text.encode())
        # A pre-token without cuts is remembered as itself, not as its only fragment too.
        packed = b"".join(map(self.fragment, fragments)) if len(fragments) > 1 else np.array(self.merge(fragments[0]), "<u4").tobytes()
        if len(text) <= LONGEST_REMEMBERED:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            self._known[text] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        parts = self.marks.split(text) if self.marks else [text]
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(np.array([self.special[part]], "<u4").tobytes())
                continue
            pieces = self.split.findall(part)
            known = list(map(self._known.get, pieces))
            if None in known:
                known = [self.piece(p) if x is None else x for p, x in zip(pieces, known, strict=True)]
            out += known
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4").tolist()
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once in each Python process."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column of token ids.  ``path``: a vocabulary file that every executor has."""
    order = [c for c in docs.columns if c != ids]
    schema = ", ".join(f"{quoted(c)} {docs.schema[c].dataType.simpleString()}" for c in order) + f", {quoted(ids)} array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            packed = [v.encode(x or "") for x in batch.column(order.index(text)).to_pylist()]
            at = np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*order, ids])

    return docs.select(*map(quoted, order)).mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text that a column of ids stands for; null ids decode to an empty text."""
    order = [c for c in docs.columns if c != text]
    schema = ", ".join(f"{quoted(c)} {docs.schema[c].dataType.simpleString()}" for c in order) + f", {quoted(text)} string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            lists = batch.column(order.index(ids))
            at, there = lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")  # never a Python number for each id
            out = pa.array([v.decode(flat[a:b].tobytes()) if ok else "" for a, b, ok in zip(at[:-1], at[1:], there, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*order, text])

    return docs.select(*map(quoted, order)).mapInArrow(run, schema)


def encoded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with token ids in the place of the text, their number, and the digest of the text decoded from them.

    Texts go to Python once and do not come back: one process a task, not one for each direction.
    """
    order = [c for c in docs.columns if c != text]
    kept = "".join(f"{quoted(c)} {docs.schema[c].dataType.simpleString()}, " for c in order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            texts = batch.column(len(order))
            for a in range(0, len(texts), ROWS):
                packed = [v.encode(x or "") for x in texts[a:a + ROWS].to_pylist()]
                at = np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    *(c[a:a + ROWS] for c in batch.columns[:-1]), pa.array(np.diff(at).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(packed), "<i4"))),
                    pa.array([hashlib.sha256(v.decode(x).encode()).hexdigest() for x in packed], pa.string())],
                    names=[*order, "n_tokens", "ids", "decoded_sha256"])

    return docs.select(*map(quoted, [*order, text])).mapInArrow(run, f"{kept}n_tokens long, ids array<int>, decoded_sha256 string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: number of ids, their digest, and the digest of the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            packed = list(map(v.encode, (x or "" for x in batch.column(1).to_pylist())))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(x) // 4 for x in packed], pa.int64()),
                pa.array(list(map(sha, packed)), pa.string()),
                pa.array([sha(v.decode(x).encode()) for x in packed], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
