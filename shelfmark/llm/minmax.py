"""Near duplicates by min-max hashing.

Every permutation of the shingle hashes gives two signature values, the least
and the greatest, so half as many permutations are evaluated as there are
values.  Bands of values propose links; every link is confirmed on the full
shingle sets.

Equal word sequences are one *content*; only contents are compared.  Within a
band bucket nobody is paired with everybody:

1. each content is checked against the bucket's smallest one (a star, one pair
   per member), and components are formed of the confirmed links;
2. only buckets that still hold several components are looked at again.  Members
   of a bucket's largest component need not meet one another; all others, the
   *seekers*, visit the bucket's members in blocks of bounded size, and only those
   whose sets are of linkable size.  Signatures say which pairs may be linked, and
   those are compared on the full sets inside the task; only links that join two
   components leave it.

The full sets of all contents that share a bucket with another are computed once,
in one exchange of the texts, and serve both steps.

With BANDS bands of ROWS values a link at the threshold is missed by all bands
with a probability of 5e-6; the estimate's margin is five standard deviations.

A text without words has an empty set, no links, and stays.  Rows that share an
id are one document.  Rows without an id take part; they come after all ids, and
a component of nothing but such rows has a null id (its rows stay).  An empty table returns no
rows.  Extra columns pass through ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import (
    BLANKS, blocks, buffers, folded, lower_bytes, mixed, row_windows, settled, stored, unfolded, window_hashes, word_bounds, word_hashes)

SHINGLE, PERCENT = 5, 75
PERMUTATIONS, ROWS, BANDS = 64, 4, 32
#: Least estimated similarity that is checked: five standard deviations below the threshold.
ESTIMATE = 0.55
#: Members of a bucket in one block, and seekers that visit it together.
MEMBERS, SEEKERS = 1000, 4000
#: Nodes without an id are numbered from here.
NO_ID = 1 << 62

_rng = np.random.default_rng(97)
_FACTOR = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def _shingles(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of texts: first and last row, shingle hashes of all rows, where each row's start, and word hashes' digest."""
    data, at = buffers(texts)
    data = lower_bytes(data)
    for first, last in blocks(at):
        part, edges = data[at[first]:at[last]], at[first:last + 1] - at[first]
        starts, ends, per_row = word_bounds(part, edges)
        h = word_hashes(part, starts, ends)
        where = row_windows(per_row, SHINGLE)
        w = window_hashes(h, SHINGLE)[where]
        begin = np.searchsorted(where, per_row)
        counts = np.diff(per_row)
        short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
        if len(short):  # a short text is one shingle, told apart by its number of words
            lone = np.array([window_hashes(h[per_row[r]:per_row[r + 1]], int(counts[r]))[0] + np.uint64(counts[r]) for r in short])
            w = np.insert(w, begin[short], lone)
            begin = begin + np.searchsorted(short, np.arange(len(begin)))
        # The digest of a whole sequence: position-weighted, with the number of words.
        place = np.arange(len(h)) - np.repeat(per_row[:-1], counts)
        digests = []
        for salt in (0x51ED270B, 0x2545F491):
            x = mixed(h + np.uint64(salt)) * mixed(place.astype(np.uint64) + np.uint64(salt * 3))
            sums = np.concatenate(([np.uint64(0)], np.cumsum(x, dtype=np.uint64)))
            digests.append(mixed(sums[per_row[1:]] - sums[per_row[:-1]] + counts.astype(np.uint64)))
        yield first, last, w, begin, np.stack(digests)


SIGNED = "doc_id long, k1 long, k2 long, n_shingles long, bands array<long>, signature binary"


def signed(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Content digest, number of shingles, band keys and signature of each text (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, last, w, begin, digest in _shingles(batch.column(1)):
                sizes = [len(np.unique(w[a:b])) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
                full = np.flatnonzero(np.diff(begin))
                values = np.zeros((2 * PERMUTATIONS, len(full)), np.uint64)
                for k in range(PERMUTATIONS) if len(full) else ():
                    v = w * _FACTOR[k] + _SHIFT[k]
                    values[k] = np.minimum.reduceat(v, begin[full])
                    values[PERMUTATIONS + k] = np.maximum.reduceat(v, begin[full])
                bands = np.zeros((len(full), BANDS), np.uint64)
                for b in range(BANDS):
                    key = np.full(len(full), b + 1, np.uint64)
                    for row in values[b * ROWS:(b + 1) * ROWS]:
                        key = mixed(key + row)
                    bands[:, b] = key
                short = np.ascontiguousarray((mixed(values) >> np.uint64(48)).astype("<u2").T)
                listed, signature = [None] * (last - first), [None] * (last - first)
                for r, b, s in zip(full.tolist(), bands.view(np.int64), short, strict=True):
                    listed[r], signature[r] = b, s.tobytes()
                text = [batch.column(1)[first:last]] if with_text else []
                yield pa.RecordBatch.from_arrays([
                    ids[first:last], pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)),
                    pa.array(sizes, pa.int64()), pa.array(listed, pa.list_(pa.int64())), pa.array(signature, pa.binary()), *text],
                    names=["doc_id", "k1", "k2", "n_shingles", "bands", "signature", *(["text"] if with_text else [])])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SIGNED + (", text string" if with_text else ""))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """node and sorted shingle hashes of each text with words; rows without an id by their content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_pylist()
            for first, _, w, begin, digest in _shingles(batch.column(1)):
                out, sets = [], []
                lone = (digest[0].view(np.int64) & (NO_ID - 1)) | NO_ID
                for r in np.flatnonzero(np.diff(begin)).tolist():
                    out.append(int(lone[r]) if nodes[first + r] is None else nodes[first + r])
                    sets.append(np.unique(w[begin[r]:begin[r + 1]]).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "node long, shingles binary")


def _of_nodes(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """The documents whose id is needed, and all without an id (their node is known by content only)."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.filter(F.col("doc_id").isNotNull()).join(needed, "doc_id", "left_semi").unionByName(rows.filter(F.col("doc_id").isNull()))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``linked``: whether the full sets (node, shingles) are similar enough."""
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                every = np.sort(np.concatenate((x, y)))
                common = int((every[1:] == every[:-1]).sum())
                linked.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    # Rows that share an id may give a pair several times: one confirmation is enough.
    return both.mapInArrow(run, "a long, b long, linked boolean").groupBy("a", "b").agg(F.max("linked").alias("linked"))


def components(edges: DataFrame) -> DataFrame:
    """node and the smallest node that it is connected with (nodes of ``edges`` only)."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        seen = labels.select(F.col("node").alias("b"), F.col("component").alias("c"))
        least = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("m"))
        near = labels.join(least, "node").select("node", F.col("component").alias("was"), F.least("component", "m").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("jumped"))
        new = stored(near.join(jump, "to").select("node", "was", F.least("to", "jumped").alias("component")), "labels")
        labels = new.select("node", "component")
        if new.filter(F.col("was") != F.col("component")).isEmpty():
            return labels


EDGES = "a long, b long"


def _partners(i: int, home: np.ndarray, seeks: np.ndarray, parts: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Members at home in a block that seeker ``i`` may be linked with, by components, sizes and signatures."""
    # Two seekers of one block meet once.
    other = home & ((~seeks) | (np.arange(len(home)) > i) | (not home[i]))
    js = np.flatnonzero(other & (parts != parts[i]))
    js = js[100 * np.minimum(sizes[js], sizes[i]) >= PERCENT * np.maximum(sizes[js], sizes[i])]
    return js[(values[js] == values[i]).mean(axis=1) >= ESTIMATE]


MEMBER = "band long, size int, block int, wave int, home boolean, seeks boolean, node long, component long, n_shingles long, signature binary"
BLOCK_KEY = ["band", "size", "block", "wave"]


def _facts(table: pa.Table) -> tuple[np.ndarray, ...]:
    home, seeks = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("home", "seeks"))
    values = np.stack([np.frombuffer(s.as_buffer(), "<u2") for s in table.column("signature").combine_chunks()])
    return home, seeks, table.column("component").to_numpy(), table.column("n_shingles").to_numpy(), values


def _doubtful(table: pa.Table) -> pa.Table:
    """The members of one block, and its visitors, that may be linked with another component's."""
    home, seeks, parts, sizes, values = _facts(table)
    seen = np.zeros(len(home), bool)
    for i in np.flatnonzero(seeks).tolist():
        js = _partners(i, home, seeks, parts, sizes, values)
        seen[js] = True
        seen[i] |= len(js) > 0
    return table.filter(pa.array(seen))


def _links(table: pa.Table) -> pa.Table:
    """Confirmed links of one block that join components.

    Signatures say which pairs may be similar enough; those are compared on their
    full sets.  A pair whose components are joined already needs no comparison.
    """
    home, seeks, parts, sizes, values = _facts(table)
    nodes = table.column("node").to_numpy()
    sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in table.column("shingles").combine_chunks()]
    sizes = np.array([len(s) for s in sets])
    start = np.cumsum(sizes) - sizes
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(int(ids.max()) + 1, np.int32)
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    out = []
    for i in np.flatnonzero(seeks).tolist():
        js = _partners(i, home, seeks, parts, sizes, values)
        if len(js) == 0:
            continue
        own = ids[start[i]:start[i] + sizes[i]]
        mark[own] = 1
        index = np.arange(int(sizes[js].sum())) + np.repeat(start[js] - (np.cumsum(sizes[js]) - sizes[js]), sizes[js])
        common = np.add.reduceat(mark[ids[index]], np.cumsum(sizes[js]) - sizes[js])
        mark[own] = 0
        for j in js[100 * common >= PERCENT * (sizes[i] + sizes[js] - common)].tolist():
            if root(int(parts[i])) != root(int(parts[j])):
                up[root(int(parts[i]))] = root(int(parts[j]))
                out.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
    return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})


def residual(banded: DataFrame, contents: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components that share a bucket, from buckets that hold several.

    A bucket's members are at home in blocks by the class of their set's size (a
    factor of 4/3, so linkable sizes are in one class or in neighbouring ones).
    Seekers visit all blocks of these classes; where there are very many seekers,
    they come in waves, and a block is there for each of them.
    """
    part = banded.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    by_component = part.groupBy("band", "component").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("who"))
    several = by_component.groupBy("band").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("components"), F.bit_xor("who").alias("who")).filter("components > 1")
    # Near copies share many bands: a bucket of the same members is looked at once.
    several = several.groupBy("who", "n", "most", "main", "components").agg(F.min("band").alias("band")).select(
        "band", "main", F.ceil((F.col("n") - F.col("most")) / float(SEEKERS)).cast("int").alias("waves"))
    rows = (part.join(several, "band").join(contents.select("node", "signature", "n_shingles"), "node")
            .withColumns({"own": F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(100.0 / PERCENT))).cast("int"),
                          "seeks": F.col("component") != F.col("main")}))
    rows = stored(rows, "members")
    blocks_of = rows.groupBy("band", F.col("own").alias("size")).agg(
        F.ceil(F.count(F.lit(1)) / float(MEMBERS)).cast("int").alias("blocks"))
    columns = ["seeks", "node", "component", "n_shingles", "signature"]
    placed = (rows.select("band", "waves", F.col("own").alias("size"), *columns).join(blocks_of, ["band", "size"])
              .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    at_home = placed.withColumn("wave", F.explode(F.sequence(F.lit(0), F.col("waves") - 1))).withColumn("home", F.lit(True))
    visits = (rows.filter("seeks").withColumn("wave", F.pmod(F.xxhash64("node", F.lit(7)), F.col("waves")).cast("int"))
              .select("band", "wave", "own", F.explode(F.array(*[F.col("own") + d for d in (-1, 0, 1)])).alias("size"), *columns)
              .join(blocks_of, ["band", "size"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              # A seeker looks round its own block as one of its members, in its own wave; there it is no visitor.
              .withColumn("home", F.lit(False))
              .filter(~((F.col("own") == F.col("size")) & (F.col("block") == F.pmod(F.xxhash64("node"), F.col("blocks"))))))
    at_home = at_home.withColumn("seeks", F.col("seeks") & (F.col("wave") == F.pmod(F.xxhash64("node", F.lit(7)), F.col("waves"))))
    order = [*BLOCK_KEY, "home", *columns]
    met = at_home.select(*order).unionByName(visits.select(*order))
    # Full sets travel only for members that the signatures leave in doubt.
    doubtful = stored(met.groupBy(*BLOCK_KEY).applyInArrow(_doubtful, MEMBER), "doubtful")
    return doubtful.join(sets, "node").groupBy(*BLOCK_KEY).applyInArrow(_links, EDGES).distinct()


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2, n_shingles and component (null if the text has no words) of each row."""
    rows = stored(signed(docs), "signed")
    lone = F.col("k1").bitwiseAND(F.lit(NO_ID - 1)).bitwiseOR(F.lit(NO_ID))
    contents = stored(rows.filter("n_shingles > 0").groupBy("k1", "k2").agg(
        F.min(F.coalesce("doc_id", lone)).alias("node"), F.first("n_shingles").alias("n_shingles"),
        F.first("bands").alias("bands"), F.first("signature").alias("signature")), "contents")
    banded = stored(contents.select(F.explode("bands").alias("band"), "node"), "banded")
    # One row per band and task: hot buckets are reduced before they meet.
    star = banded.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("top")).filter("a <> top").select("band", "a")
    met = stored(banded.join(star, "band").select("a", "node"), "met")
    pairs = stored(met.filter("node <> a").select("a", F.col("node").alias("b")).distinct(), "pairs")
    # All contents of these buckets: a merge join at every size, so that texts cross the network once.
    sets = stored(shingle_sets(_of_nodes(docs, met.select(F.col("node").alias("doc_id")).distinct().hint("merge"))), "sets")
    checked = stored(confirmed(pairs, sets).filter("linked").select("a", "b"), "checked")
    more = stored(residual(banded, contents, components(checked), sets), "more")
    labels = components(checked.unionByName(more))
    # Contents that no confirmed link touches stand alone; one id may stand for several contents.
    of_content = contents.select("k1", "k2", "node").join(labels, "node", "left").select(
        "k1", "k2", F.coalesce("component", "node").alias("component"))
    return rows.select("doc_id", "k1", "k2", "n_shingles").join(of_content, ["k1", "k2"], "left")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: set size, component id and whether it stays."""
    id_ = F.when(F.col("component").isNull(), F.col("doc_id")).when(F.col("component") < NO_ID, F.col("component"))
    rows = settled(lambda: grouped(docs).select("doc_id", "n_shingles", id_.alias("component_id")), "grouped")
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` without all but one document of each component.

    Rows with an id stay if theirs is the component's; repeated ones of these stay
    once.  Of rows without an id one stays for a component that has no id at all.
    Rows without words stay, repeated ones once.
    """
    rows = folded(docs)
    lone = F.col("k1").bitwiseAND(F.lit(NO_ID - 1)).bitwiseOR(F.lit(NO_ID))
    own = F.when(F.col("doc_id").isNull(), lone).otherwise(F.col("doc_id"))
    chosen = settled(lambda: grouped(docs).filter(F.col("component").isNotNull() & (own == F.col("component"))).select(
        F.col("doc_id").alias("id"), "k1", "k2").distinct(), "chosen")
    plain = F.coalesce(F.btrim("text", F.lit(BLANKS)), F.lit("")) == ""
    has_id = F.col("doc_id").isNotNull()
    with_id = rows.filter(has_id & ~plain).join(
        chosen.filter("id IS NOT NULL").select("id").distinct(), F.col("doc_id").cast("long") == F.col("id"), "left_semi")
    # Rows without an id are known by their words only.
    texts = rows.filter(~has_id & ~plain).select("text").distinct()
    keyed = signed(texts.withColumn("doc_id", F.lit(None).cast("long")), with_text=True).join(chosen.filter("id IS NULL"), ["k1", "k2"], "left_semi")
    first = keyed.groupBy("k1", "k2").agg(F.min("text").alias("text")).select("text")
    without = rows.filter(~has_id & ~plain).join(first, "text", "left_semi")
    kept = with_id.unionByName(without).unionByName(rows.filter(plain))
    # Repeated rows of one document: one of them.
    kept = kept.withColumn("_same", F.xxhash64("text")).dropDuplicates(["doc_id", "_same"])
    return unfolded(kept, docs.columns)
