"""Phrase collocations from weighted acyclic automata over shard n-grams.

A task cuts its texts into shards.  A shard's n-grams, sorted, make an acyclic
automaton in one pass: equal prefixes share their arcs, every arc carries how
often its n-gram occurs, and all longest n-grams end in one state.  It is held
as arrays: per state what leads to it and its number of arcs, per arc the next
word and a weight.

Automata are cut by *prefix range* and sent there; a range's task unites them:
equal paths become one, their weights are added.  Only paths whose weight
reaches the threshold leave the range, because a rarer n-gram can be neither
a candidate nor a part of one.  What is left is a relation (phrase, weight) in
three levels; the parts of a candidate are looked up by composing it with that
relation, an equi-join of arcs on the state they start from.

No range is hot.  A prefix range is a range of states (one word, or two); the
arcs of one state are dealt to ``SLICES`` ranges by their word, so a word or a
pair of words that every document holds is spread as well.  A shard sends an n-gram
once, however often it occurs.  Ranges grow in number with the text.

Words carry their language: the same word of two languages is two labels.  A
label is a 64-bit hash (48 bits below one prefix, where only the followers of
two given words must differ); the strings travel with the single words.

Null and empty texts give nothing; a null language is ``und``; repeated rows
count each time; an empty table gives no rows.  Only ``text`` and ``lang`` are
looked at, whatever other columns are called.  Ties of score and weight go by
the phrase's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import common
from shelfmark.llm.common import blocks, buffers, lower_bytes, mixed, packed, stored, unpacked, word_hashes
from shelfmark.skew import top_rows

#: What ends a piece of text, and what else separates words.
ENDS, GAPS = ".,;:!?\n\x0b\x0c\r", " \t"
#: Least weight of a candidate; a longer candidate with this share of its weight drops it; rows for each language.
LEAST, SHARE_PERCENT, TOP = 10, 50, 2000
NO_LANGUAGE = "und"
#: Words of one shard (labels are numbered inside it, three numbers in 63 bits), and bytes of text split at once.
SHARD_WORDS = 700_000
BLOCK = 1 << 20
#: N-grams of one range, and ranges that the arcs of one prefix are dealt to.
RANGE_GRAMS, SLICES = 1 << 20, 16

_END = np.zeros(256, bool)
_END[[ord(c) for c in ENDS]] = True
_GAP = _END.copy()
_GAP[[ord(c) for c in GAPS]] = True
_SALT = np.uint64(0x9E6C63D0876A9A47)
_SHIFT = np.uint64(16)


# --- words ----------------------------------------------------------------

def _slices(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, row starts and rows of blocks of a batch; a long text is cut between words (its rest starts no row)."""
    for first, last in blocks(at, BLOCK):
        start, stop = int(at[first]), int(at[last])
        if last > first + 1 or stop - start <= 2 * BLOCK:
            yield data[start:stop], at[first:last] - start, np.arange(first, last)
            continue
        begin = start
        while begin < stop:
            gap = _GAP[data[begin + BLOCK:stop]]
            end = begin + BLOCK + int(gap.argmax()) if gap.any() else stop
            yield data[begin:end], np.zeros(int(begin == start), np.int64), np.array([first])
            begin = end


def _words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and piece number of every word; rows start at ``starts``, and so do pieces."""
    inside = ~_GAP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    edge[-1] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    breaks = _END[data].astype(np.int32)
    breaks[starts[starts < len(data)]] += 1
    first = np.flatnonzero(start)
    return first, np.flatnonzero(end) + 1, np.cumsum(breaks, dtype=np.int64)[first]


def prefix_code(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A 64-bit code of a two-word prefix."""
    return mixed(first * np.uint64(3) + mixed(second + _SALT))


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    sizes = ends - starts
    at = np.concatenate(([0], np.cumsum(sizes)))
    index = np.arange(int(at[-1])) + np.repeat(starts - at[:-1], sizes)
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data[index].tobytes()))


def _counts(values: np.ndarray) -> bytes:
    """Counts, one byte each and larger ones (255) in full behind them."""
    large = values[values >= 255]
    return np.minimum(values, 255).astype(np.uint8).tobytes() + large.astype("<i8").tobytes()


def _counted(blob: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(blob, np.uint8, n).astype(np.int64)
    large = out == 255
    out[large] = np.frombuffer(blob, "<i8", int(large.sum()), n)
    return out


# --- shards ---------------------------------------------------------------

def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)


class Shard:
    """The automaton of one shard: sorted n-grams, a level of arcs for each of their words."""

    def __init__(self, labels: np.ndarray, pieces: np.ndarray, lead: int):
        """``labels`` of consecutive words; n-grams start at one of the first ``lead``."""
        self.labels, ids = np.unique(labels, return_inverse=True)
        self.n = n = np.int64(len(self.labels))
        together = pieces[1:] == pieces[:-1]
        pair = (ids[:-1] * n + ids[1:])[:lead]
        triple = (ids[:-2] * n + ids[1:-1])[:lead] * n + ids[2:][:lead]
        del ids
        self.pairs, self.pair_weight = np.unique(pair[together[:lead]], return_counts=True)
        self.triples, self.triple_weight = np.unique(triple[(together[:-1] & together[1:])[:lead]], return_counts=True)

    def _level(self, from_: np.ndarray, width: int, to: np.ndarray, to_width: int, weight: np.ndarray, place: np.ndarray, level: int):
        """Arcs in their ranges; what arcs of one state share is written once, with their number."""
        order = np.argsort(place, kind="stable")
        bounds = np.append(_runs(place[order]), len(order))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            rows = order[a:b]
            states = from_[rows]
            new = _runs(states)
            arcs = np.diff(np.append(new, len(rows)))
            yield (int(place[rows[0]]), level, np.int64(len(new)).tobytes() + packed(states[new], width) + packed(to[rows], to_width),
                   _counts(np.concatenate((arcs, weight[rows]))))

    def cut(self, bits: int) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(range, level, labels, weights) of the second and third level."""
        first, second = self.labels[self.pairs // self.n], self.labels[self.pairs % self.n]
        yield from self._level(first, 8, second, 8, self.pair_weight, _slice_of(_range_of(first, bits), second, bits), 2)
        del first, second
        before = self.triples // self.n
        prefix = prefix_code(self.labels[before // self.n], self.labels[before % self.n])
        third = self.labels[self.triples % self.n] >> _SHIFT
        yield from self._level(_within(prefix, bits), 6, third, 6, self.triple_weight, _slice_of(_range_of(prefix, bits), third, bits), 3)


class Singles:
    """The first level, with strings: distinct words of a shard, each with its language behind a line break."""

    def __init__(self):
        self.labels: list[np.ndarray] = []
        self.weights: list[np.ndarray] = []
        self.words: list[pa.Array] = []

    def add(self, labels: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, languages: pa.Array, row: np.ndarray) -> None:
        known, first, weight = np.unique(labels, return_index=True, return_counts=True)
        self.labels.append(known)
        self.weights.append(weight)
        self.words.append(pc.binary_join_element_wise(
            _strings(data, starts[first], ends[first]), languages.take(pa.array(row[first])).cast(pa.large_string()), pa.scalar("\n", pa.large_string())))

    def cut(self, bits: int) -> Iterator[tuple[int, int, bytes, bytes]]:
        labels, first, back = np.unique(np.concatenate(self.labels), return_index=True, return_inverse=True)
        weight = np.bincount(back, np.concatenate(self.weights)).astype(np.int64)
        data, at = buffers(pa.concat_arrays(self.words).take(pa.array(first)))
        bounds = np.append(_runs(_range_of(labels, bits)), len(labels))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield (int(_range_of(labels[a:a + 1], bits)[0]), 1,
                   np.int64(b - a).tobytes() + packed(labels[a:b], 8) + data[at[a]:at[b]].tobytes(),
                   _counts(np.concatenate((weight[a:b], np.diff(at[a:b + 1])))))


def _range_of(code: np.ndarray, bits: int) -> np.ndarray:
    return (code >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(code), np.int64)


def _within(prefix: np.ndarray, bits: int) -> np.ndarray:
    """The bits of the code that follow those of the range: 48, or as many as make 63 with them."""
    return (prefix << np.uint64(bits)) >> np.uint64(64 - min(48, 63 - bits))


def _slice_of(place: np.ndarray, to: np.ndarray, bits: int) -> np.ndarray:
    """Range of an arc: its state's own, moved by the slice that the next word falls into."""
    many = 1 << bits
    return (place + (to % np.uint64(SLICES)).astype(np.int64) * max(1, many // SLICES)) % many


def _own_range(place: int, to: np.ndarray, bits: int) -> np.ndarray:
    many = 1 << bits
    return (place - (to % np.uint64(SLICES)).astype(np.int64) * max(1, many // SLICES)) % many


CUT = "range int, level int, labels binary, weights binary"


def _language_salts(languages: pa.Array) -> np.ndarray:
    """A 64-bit value for the language of each row."""
    codes = languages.dictionary_encode()
    data, at = buffers(codes.dictionary)
    h = [word_hashes(data, at[k:k + 1], at[k + 1:k + 2])[0] if at[k + 1] > at[k] else np.uint64(0) for k in range(len(at) - 1)]
    return mixed(np.array(h, np.uint64) ^ _SALT)[codes.indices.to_numpy()]


def cut_automata(docs: DataFrame, bits: int) -> DataFrame:
    """The shards' automata in pieces, one row per shard, level and range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, pieces, held, piece = [], [], 0, 0
        singles = Singles()

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal labels, pieces, held, singles
            every, piece_of = np.concatenate(labels), np.concatenate(pieces)
            lead = len(every) if last else len(every) - 2
            if singles.labels:
                yield from _rows(singles.cut(bits))
            yield from _rows(Shard(every, piece_of, lead).cut(bits))
            pa.default_memory_pool().release_unused()
            # The next shard starts with the two words that this one only looked at.
            labels, pieces, held, singles = [every[lead:]], [piece_of[lead:]], len(every) - lead, Singles()

        for batch in batches:
            data, at = buffers(batch.column(0))
            salts = _language_salts(batch.column(1))
            for part, begins, rows in _slices(data, at):
                part = lower_bytes(part)
                starts, ends, number = _words(part, begins)
                if len(starts) == 0:
                    piece += int(_END[part].any()) + len(begins)
                    continue
                row = rows[np.maximum(np.searchsorted(begins, starts, "right") - 1, 0)]
                h = mixed(word_hashes(part, starts, ends) ^ salts[row])
                singles.add(h, part, starts, ends, batch.column(1), row)
                labels.append(h)
                pieces.append(number + piece)
                # A piece may go on in the next slice of a long text, so only what ended here counts.
                piece += int(_END[part].sum()) + len(begins)
                held += len(h)
                if held >= SHARD_WORDS:
                    yield from flush(False)
        if labels:
            yield from flush(True)

    texts = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang")).filter("text <> ''")
    return texts.mapInArrow(run, CUT)


def _rows(cuts: Iterator[tuple[int, int, bytes, bytes]], most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size."""
    held, size = [], 0
    for cut in cuts:
        held.append(cut)
        size += len(cut[2]) + len(cut[3])
        if size > most:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(cuts: list) -> pa.RecordBatch:
    place, level, labels, weights = zip(*cuts, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(place, pa.int32()), pa.array(level, pa.int32()), pa.array(labels, pa.binary()), pa.array(weights, pa.binary())],
        names=["range", "level", "labels", "weights"])


# --- union by prefix range ------------------------------------------------

UNITED = "level int, lang string, word string, first long, second long, prefix long, weight long"
_TYPES = {"level": pa.int32(), "lang": pa.string(), "word": pa.string(), "first": pa.int64(), "second": pa.int64(),
          "prefix": pa.int64(), "weight": pa.int64()}


def _united_rows(n: int, **columns) -> pa.Table:
    return pa.table({c: pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in _TYPES.items()})


def _summed(columns: list[np.ndarray], weight: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal paths as one, their weights added; those below the threshold left out."""
    order = np.argsort(mixed(columns[0] * np.uint64(3) + mixed(columns[1] + _SALT)), kind="stable")
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(new)
    total = np.add.reduceat(weight[order], at)
    keep = total >= LEAST
    return [c[at[keep]] for c in columns], total[keep]


def _arcs(labels: list[bytes], weights: list[bytes], width: int, to_width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State, next word and weight of every arc of a level's pieces."""
    from_, to, weight = [], [], []
    for blob, counts in zip(labels, weights, strict=True):
        states = int(np.frombuffer(blob, np.int64, 1)[0])
        middle = 8 + width * states
        n = (len(blob) - middle) // to_width
        counts = _counted(counts, states + n)
        from_.append(np.repeat(unpacked(blob[8:middle], width), counts[:states]))
        to.append(unpacked(blob[middle:], to_width))
        weight.append(counts[states:])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (from_, to, weight))


def _united_singles(labels: list[bytes], weights: list[bytes]) -> list[pa.Table]:
    """Words of a range that are frequent enough, and how many words each language has here."""
    known, weight, words = [], [], []
    for blob, counts in zip(labels, weights, strict=True):
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        counts = _counted(counts, 2 * n)
        known.append(np.frombuffer(blob, np.int64, n, 8) if n == 0 else unpacked(blob[8:8 + 8 * n], 8).view(np.int64))
        weight.append(counts[:n])
        at = np.concatenate(([0], np.cumsum(counts[n:])))
        words.append(pa.LargeStringArray.from_buffers(n, pa.py_buffer(at), pa.py_buffer(blob[8 + 8 * n:])))
    table = pa.table({"label": np.concatenate(known), "weight": np.concatenate(weight), "word": pa.chunked_array(words)})
    table = table.group_by(["label", "word"]).aggregate([("weight", "sum")])
    both = pc.split_pattern(table["word"], "\n", max_splits=1).combine_chunks()
    word, lang = pc.list_element(both, 0).cast(pa.string()), pc.list_element(both, 1).cast(pa.string())
    totals = pa.table({"lang": lang, "weight": table["weight_sum"]}).group_by("lang").aggregate([("weight", "sum")])
    keep = pc.greater_equal(table["weight_sum"].combine_chunks(), LEAST)
    kept = [x.filter(keep) for x in (lang, word, table["label"].combine_chunks(), table["weight_sum"].combine_chunks())]
    return [_united_rows(len(totals), level=np.zeros(len(totals), np.int32), lang=totals["lang"].combine_chunks(),
                         weight=totals["weight_sum"].combine_chunks()),
            _united_rows(len(kept[0]), level=np.ones(len(kept[0]), np.int32), lang=kept[0], word=kept[1], first=kept[2], weight=kept[3])]


def _united(key: tuple, table: pa.Table, bits: int) -> pa.Table:
    """The union of all shards' automata in one prefix range, as rows (level, labels, weight).

    Level 0 rows hold the number of words of a language in this range.
    """
    level = table.column("level").to_numpy()
    part = {k: [table.column(c).filter(pa.array(level == k)).to_pylist() for c in ("labels", "weights")] for k in (1, 2, 3)}
    out = [pa.schema(_TYPES).empty_table()]
    if part[1][0]:
        out += _united_singles(*part[1])
    if part[2][0]:
        first, second, weight = _arcs(*part[2], 8, 8)
        (x, y), total = _summed([first, second], weight)
        code = prefix_code(x, y) >> np.uint64(64 - bits - min(48, 63 - bits))
        out.append(_united_rows(len(x), level=np.full(len(x), 2, np.int32), first=x.view(np.int64), second=y.view(np.int64),
                                prefix=code.astype(np.int64), weight=total))
    if part[3][0]:
        prefix, third, weight = _arcs(*part[3], 6, 6)
        own = _own_range(int(key[0].as_py()), third, bits).astype(np.uint64) << np.uint64(min(48, 63 - bits))
        (p, t), total = _summed([prefix | own, third], weight)
        out.append(_united_rows(len(p), level=np.full(len(p), 3, np.int32), prefix=p.astype(np.int64), second=t.astype(np.int64), weight=total))
    return pa.concat_tables(out)


def range_bits(text_size: int) -> int:
    """Ranges (as a power of two) for this many bytes of text: about a word in six bytes, two n-grams a word."""
    return min(30, max(0, int(text_size / 3 / RANGE_GRAMS).bit_length()))


def united(docs: DataFrame) -> DataFrame:
    """All frequent n-grams of ``docs``: level, labels and weight; level 0: words of each language."""
    bits = range_bits(common.text_bytes(docs))
    cut = cut_automata(docs, bits)
    return stored(cut.groupBy("range").applyInArrow(lambda key, table: _united(key, table, bits), UNITED), "ngrams")


# --- composition ----------------------------------------------------------

def _score(left: str, right: str):
    """floor(1000000 a a / (l r)) of one cut: an integer division of exact decimals."""
    a, l, r = (F.col(x).cast("decimal(15,0)") for x in ("a", left, right))
    return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), l * r)


def candidates(ngrams: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, phrase, words, a, l, r, score of all phrases of two or three words, and ``inside``: the largest a of a longer one around."""
    words = ngrams.filter("level = 1").select("lang", "word", F.col("first").alias("label"), F.col("weight").alias("f"))
    pairs = ngrams.filter("level = 2").select("first", "second", "prefix", F.col("weight").alias("a"))

    def word(k: int) -> DataFrame:
        return words.select(*([F.col("lang")] if k == 1 else []), F.col("label").alias(f"h{k}"), F.col("word").alias(f"w{k}"), F.col("f").alias(f"f{k}"))

    arcs = ngrams.filter("level = 3").select("prefix", F.col("second").alias("third"), F.col("weight").alias("a"))
    heads = pairs.select("prefix", F.col("first").alias("h1"), F.col("second").alias("h2"), F.col("a").alias("f12"))
    tails = pairs.select(F.col("first").alias("h2"), F.shiftrightunsigned("second", 16).alias("third"), F.col("second").alias("h3"),
                         F.col("a").alias("f23"))
    triples = stored(arcs.join(heads, "prefix").join(tails, ["h2", "third"]).select("h1", "h2", "h3", "a", "f12", "f23"), "triples")
    around = (triples.select(F.explode(F.array(F.struct(F.col("h1").alias("h1"), F.col("h2").alias("h2")),
                                               F.struct(F.col("h2").alias("h1"), F.col("h3").alias("h2")))).alias("p"), "a")
              .groupBy("p.h1", "p.h2").agg(F.max("a").alias("inside")))
    two = (pairs.select(F.col("first").alias("h1"), F.col("second").alias("h2"), "a").join(around, ["h1", "h2"], "left")
           .join(word(1), "h1").join(word(2), "h2")
           .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.lit(2).alias("words"), "a",
                   F.col("f1").alias("l"), F.col("f2").alias("r"), "inside").withColumn("score", _score("l", "r")))
    cut = {1: _score("f1", "f23"), 2: _score("f12", "f3")}
    three = (triples.join(word(1), "h1").join(word(2), "h2").join(word(3), "h3")
             .withColumns({"s1": cut[1], "s2": cut[2]}).withColumn("at1", F.col("s1") <= F.col("s2"))
             .select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.lit(3).alias("words"), "a",
                     F.when(F.col("at1"), F.col("f1")).otherwise(F.col("f12")).alias("l"),
                     F.when(F.col("at1"), F.col("f23")).otherwise(F.col("f3")).alias("r"),
                     F.lit(None).cast("long").alias("inside"), F.least("s1", "s2").alias("score")))
    return two.unionByName(three).filter(F.col("a") >= least)


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language by score."""
    ngrams = united(docs)
    n = ngrams.filter("level = 0").groupBy("lang").agg(F.sum("weight").alias("n"))
    kept = candidates(ngrams).filter(F.coalesce(100 * F.col("inside") < SHARE_PERCENT * F.col("a"), F.lit(True)))
    first = top_rows(kept, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top, "rank")
    return first.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
