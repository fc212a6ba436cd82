"""Document fingerprints by I-Match over randomised lexicon subsets.

Terms are lower-cased runs of letters and digits.  The lexicon is a band of
inverse document frequency: terms of many documents tell nothing, terms of few
are typing errors, names and numbers.  A text keeps its distinct terms of the
lexicon, sorts them, and hashes what falls into each of several random subsets
of the lexicon.  Subsets come in tiers: each tier halves the part of the
lexicon it draws from, so texts of every length have subsets with a few of
their terms.  One more hash is that of all distinct terms, in or out of the
band; it also tells texts without lexicon terms apart.

The likeness of two fingerprints is the share of equal hashes among those where
at least one of the two has terms: 1 for equal texts, and falling with the
share of lexicon terms that only one of them holds.

The band ends where a term makes up less than one in ``LEXICON`` of all (document,
term) incidences.  No more than ``LEXICON`` terms can be above that, whatever
was read: this bound is why the lexicon may be sent to every task, as a set of
64-bit term hashes in the expression.  Texts never meet a join for it.

Everything is built-in column functions.  Rows of one id and one text are one
document for the order, with one result row each.  Null texts are empty ones.
Equal ids go by the text's hash; null ids come after all others.  A single
document is its own successor.  An empty table gives no rows.  Only ``doc_id``
and ``text`` are looked at, whatever other columns are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import stored, whole_text
from shelfmark.skew import global_rank

#: A term of a larger share of all documents is too frequent.
FREQUENT = 0.1
#: A term is too rare if it is less than one of this many (document, term) incidences; also the most terms a lexicon can have.
LEXICON = 1 << 14
#: Tiers of subsets, and subsets in a tier: one of a tier holds 1 / (PER_TIER * 2 ** tier) of the lexicon.
TIERS, PER_TIER = 8, 8

_KEY = ["_k1", "_k2"]


def terms_of(text: Column) -> Column:
    """64-bit hashes of a text's distinct terms."""
    parts = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+", -1), lambda x: x != "")
    return F.array_distinct(F.transform(parts, lambda x: F.xxhash64(x)))


def document_frequencies(texts: DataFrame) -> DataFrame:
    """term (its hash) and the number of rows of ``texts`` (text) that hold it."""
    return texts.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def lexicon(texts: DataFrame, frequent: float = FREQUENT, most: int = LEXICON) -> list[int]:
    """Hashes of the terms inside the band: ``most`` at the most, since each has one in ``most`` of all incidences."""
    counts = stored(document_frequencies(texts), "frequencies")
    incidences = counts.agg(F.sum("df").alias("n")).first()["n"] or 0
    highest = max(1.0, frequent * texts.count())
    band = counts.filter((F.col("df") * F.lit(most) >= F.lit(incidences)) & (F.col("df") <= highest))
    return [r["term"] for r in band.select("term").collect()]


def _kept(terms: str, allowed: list[int]) -> Column:
    """The terms of an array column that are in the lexicon, sorted."""
    if not allowed:
        return F.slice(F.col(terms), 1, 0)
    return F.expr(f"sort_array(filter({terms}, t -> t in ({','.join(f'{t}L' if t > -(1 << 63) else 'cast(-9223372036854775808 as bigint)' for t in allowed)})))")


def subset_hashes(kept: Column, every: Column) -> Column:
    """31 bits for each subset that holds a term of the text (null otherwise), at the end those of all terms."""
    short = lambda x: F.xxhash64(x).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")

    def tier(k: int) -> Column:
        """Terms whose hash has its lowest set bit at ``k``; the last tier takes all the rest."""
        low, want = (1 << (k + 1)) - 1, 1 << k
        if k == TIERS - 1:
            low, want = low >> 1, 0
        return F.filter(kept, lambda t: t.bitwiseAND(F.lit(low)) == want)

    inside = F.transform(F.array(*[tier(k) for k in range(TIERS)]), lambda g: F.transform(
        F.sequence(F.lit(0), F.lit(PER_TIER - 1)),
        lambda s: F.filter(g, lambda t: F.shiftright(t, TIERS).bitwiseAND(F.lit(PER_TIER - 1)) == s)))
    hashes = F.transform(F.flatten(inside), lambda x: F.when(F.size(x) > 0, short(x)))
    return F.concat(hashes, F.array(short(F.sort_array(every))))


def with_hashes(rows: DataFrame, text: str, allowed: list[int], name: str) -> DataFrame:
    """``rows`` with the subset hashes of a text column."""
    rows = rows.withColumn("_terms", terms_of(F.col(text)))
    rows = rows.withColumn("_lexical", _kept("_terms", allowed))
    return rows.withColumn(name, subset_hashes(F.col("_lexical"), F.col("_terms"))).drop("_terms", "_lexical")


def written(hashes: Column) -> Column:
    """Hashes as text, eight digits each; eight dashes where a subset holds nothing."""
    return F.array_join(F.transform(hashes, lambda x: F.lpad(F.hex(x.cast("long")), 8, "0")), "", "-" * 8)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among those that at least one side has."""
    seen = F.array_compact(F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() | y.isNotNull(), F.coalesce(x == y, F.lit(False)))))
    return F.size(F.filter(seen, lambda same: same)) / F.size(seen)


def successors(keyed: DataFrame) -> DataFrame:
    """Key, copies and half length of each document with the key of the next one: ids descending, cyclic."""
    lone = keyed.groupBy(*_KEY).agg(
        F.first("doc_id").alias("doc_id"), F.first(F.floor(F.length("text") / 2)).cast("int").alias("half"), F.count(F.lit(1)).alias("copies"))
    # The order of ~id is that of -id, without overflow.
    ranked = stored(global_rank(lone.withColumns({"_null": F.col("doc_id").isNull(), "_down": F.bitwise_not("_k1")}).drop("doc_id"),
                                ["_null", "_down", "_k2"], "rank"), "ranked")
    n = ranked.count()
    onward = ranked.select((F.pmod(F.col("rank") - 1, F.lit(max(1, n)))).alias("rank"), F.col("_k1").alias("_n1"), F.col("_k2").alias("_n2"))
    return ranked.join(onward, "rank").select(*_KEY, "half", "copies", "_n1", "_n2")


def fingerprints(docs: DataFrame, frequent: float = FREQUENT, most: int = LEXICON) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and their likeness to it and to the next document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    allowed = lexicon(docs.select("text"), frequent, most)
    keyed = docs.withColumns({
        "_k1": F.coalesce("doc_id", F.lit(0).cast("long")), "_k2": F.xxhash64(F.col("doc_id").isNull(), F.col("text"))})
    links = successors(keyed)
    # One exchange of the texts by key, used from both sides: only the heads that replace text travel again.
    rows = with_hashes(keyed, "text", allowed, "hashes").dropDuplicates(_KEY)
    heads = (rows.withColumnsRenamed({"_k1": "_n1", "_k2": "_n2", "doc_id": "next_id"}).join(links, ["_n1", "_n2"])
             .select(*_KEY, "copies", "next_id", F.col("hashes").alias("next_hashes"), F.substring(F.col("text"), F.lit(1), F.col("half")).alias("head")))
    n = F.length("text")
    both = rows.join(heads, _KEY).withColumns({
        "n_chars": n.cast("long"),
        "_edited": F.concat(F.substring(F.col("text"), F.lit(1), (n - F.floor(n / 2)).cast("int")), F.col("head"))}).drop("text", "head")
    both = with_hashes(both.withColumn("edited_sha256", F.sha2("_edited", 256)), "_edited", allowed, "edited_hashes").drop("_edited")
    result = both.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("hashes")).alias("fingerprint"),
        written(F.col("edited_hashes")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"), "next_id",
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy"))
    return result.drop("_copy")
