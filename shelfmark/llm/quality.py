"""Quality rules by weak supervision.

Rules look at one document each and vote good, bad or nothing.  Nobody says
how far a rule can be trusted: expectation-maximisation over the patterns of
votes estimates, for each rule, how often it is right about good and about bad
documents, and how many documents are good.  A document's posterior
probability of being good then decides, instead of "every rule must pass".

Everything is built-in column functions.  Votes are counted by pattern: there
are at most 3 ** rules patterns, whatever the input, so the estimation works
on a small table and its result is one expression over the vote columns.

Null and empty texts have no words and fail the base rule.  Repeated rows are
judged alike.  An empty table returns no rows.  Other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import BLANKS, stored, whole_text, words_of

SYMBOLS = "#*$%&|<>"
#: Frequent small words of four languages.
FUNCTION_WORDS = (
    "the of and to in is that for it as on with by at this be are or an from "
    "der die das und ist nicht mit ein eine zu den von auf für im des dem sich "
    "le la les de et un une du est que qui dans pour par pas sur au "
    "el los las y en por con una para del al se su no es").split()
GRAM = 5
LEAST_WORDS = 10
#: A document stays if it is at least this likely to be good.
LEAST_POSTERIOR = 0.5
#: Rounds of estimation; it ends earlier when nothing moves.
ROUNDS = 200
#: A rule is right at least this often, and never taken for certain.
ACCURACY = (0.55, 0.995)

_X = "_q_"


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts that rules look at."""
    text, c = whole_text(), lambda name: F.col(_X + name)
    squeezed = F.translate(text, BLANKS, "")
    d = docs.withColumns({
        _X + "words": words_of(text),
        _X + "lines": F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != ""),
        "word_chars": F.length(squeezed).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")})
    n = F.size(c("words"))
    word = lambda i: F.get(c("words"), i)
    grams = F.transform(F.sequence(F.lit(0), n - GRAM), lambda i: F.xxhash64(*[word(i + k) for k in range(GRAM)]))
    d = d.withColumns({
        "n_words": n.cast("long"),
        "n_lines": F.size(c("lines")).cast("long"),
        "n_dup_lines": (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long"),
        "n_function": F.size(F.filter(c("words"), lambda w: F.lower(w).isin(FUNCTION_WORDS))).cast("long"),
        "n_distinct": F.size(F.array_distinct(c("words"))).cast("long"),
        _X + "grams": F.when(n >= GRAM, grams)})
    # Most texts repeat no window; only the others are looked at closely.
    again = F.size(F.array_distinct(c("grams"))) < F.size(c("grams"))
    d = d.withColumn(_X + "sorted", F.when(again, F.array_sort(
        F.transform(c("grams"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twin = lambda x, k: (F.get(c("sorted"), k - 1)["h"] == x["h"]) | (F.get(c("sorted"), k + 1)["h"] == x["h"])
    d = d.withColumn(_X + "starts", F.array_sort(F.transform(
        F.filter(c("sorted"), lambda x, k: F.coalesce(twin(x, k), F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate(
        F.transform(c("starts"), lambda p, k: F.least(F.lit(GRAM), F.coalesce(F.get(c("starts"), k + 1) - p, F.lit(GRAM)))),
        F.lit(0), lambda a, x: a + x)
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return d.drop(*[_X + x for x in ("words", "lines", "grams", "sorted", "starts")])


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """Votes of the rules: 1 good, -1 bad, 0 none."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda name: F.col(name) / n
    size = F.col("word_chars") / n
    return {
        "symbols": _vote(share("n_symbols") <= 0.02, share("n_symbols") > 0.10),
        "dup_lines": _vote((F.col("n_lines") >= 5) & (F.col("n_dup_lines") == 0),
                           F.col("n_dup_lines") > 0.3 * F.col("n_lines")),
        "repeats": _vote((n >= 50) & (share("n_repeat_words") <= 0.05), share("n_repeat_words") > 0.15),
        "word_size": _vote(size.between(2.5, 8.0), ~size.between(1.5, 15.0)),
        "function_words": _vote((n >= 20) & (share("n_function") >= 0.08), (n >= 40) & (share("n_function") <= 0.01)),
        "distinct": _vote((n >= 50) & (share("n_distinct") >= 0.2), (n >= 50) & (share("n_distinct") < 0.08)),
        "length": _vote(n >= 40, F.col("n_words") < LEAST_WORDS)}


def estimated(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[tuple[float, float]]]:
    """Log odds of good without votes, and each rule's log odds for a bad and for a good vote.

    ``patterns``: votes and how many documents cast them.  Abstaining is taken
    to say nothing.
    """
    if not patterns:
        return 0.0, []
    m, low, high = len(patterns[0][0]), *ACCURACY
    clamp = lambda x, a, b: min(max(x, a), b)
    # The start: the share of good votes among those cast.
    post = []
    for votes, _ in patterns:
        cast = [v for v in votes if v]
        bad = cast.count(-1)
        post.append(clamp(0.9 - 0.8 * bad / max(len(cast), 1) - 0.2 * (bad > 1), 0.05, 0.95))
    prior, weights, last = 0.0, [(0.0, 0.0)] * m, None
    for _ in range(ROUNDS):
        total = sum(c for _, c in patterns)
        good = clamp((sum(p * c for p, (_, c) in zip(post, patterns)) + 1) / (total + 2), 0.05, 0.95)
        weights = []
        for j in range(m):
            says = {(z, v): 1.0 for z in (0, 1) for v in (-1, 1)}
            says[1, 1] += 3.0
            says[0, -1] += 3.0
            for p, (votes, c) in zip(post, patterns):
                if votes[j]:
                    says[1, votes[j]] += p * c
                    says[0, votes[j]] += (1 - p) * c
            right_good = clamp(says[1, 1] / (says[1, 1] + says[1, -1]), low, high)
            right_bad = says[0, -1] / (says[0, -1] + says[0, 1])
            # A good vote that bad documents mostly get as well tells little, but never the opposite.
            right_bad = clamp(right_bad, 1 - right_good + 0.01, high)
            weights.append((math.log((1 - right_good) / right_bad), math.log(right_good / (1 - right_bad))))
        prior = math.log(good / (1 - good))
        odds = [prior + sum(w[0] if v < 0 else w[1] for v, w in zip(votes, weights) if v) for votes, _ in patterns]
        post = [1 / (1 + math.exp(-clamp(x, -500, 500))) for x in odds]
        if last is not None and max(abs(a - b) for a, b in zip(post, last)) < 1e-9:
            break
        last = post
    return prior, weights


def judged(docs: DataFrame, least: float = LEAST_POSTERIOR, keep_text: bool = True) -> DataFrame:
    """``docs`` with counts, votes (``vote_*``), base_failed, posterior and kept."""
    votes = rules()
    table = measured(docs).withColumns({f"vote_{k}": v for k, v in votes.items()})
    table = stored(table if keep_text else table.drop("text"), "votes")
    names = [f"vote_{k}" for k in votes]
    # At most 3 ** len(votes) rows, whatever the input.
    counted = table.groupBy(*names).count().collect()
    prior, weights = estimated(sorted((tuple(r[n] for n in names), r["count"]) for r in counted))
    odds = F.lit(prior)
    for name, (bad, good) in zip(names, weights):
        odds = odds + F.when(F.col(name) < 0, F.lit(bad)).when(F.col(name) > 0, F.lit(good)).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (table.withColumn("base_failed", failed)
            .withColumn("posterior", F.round(1 / (1 + F.exp(-odds)), 9))
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least)))


def good(docs: DataFrame, least: float = LEAST_POSTERIOR) -> DataFrame:
    """Rows of ``docs`` that are kept.

    Verdicts are stored without the texts, which would lie beside the result as
    long as it is read.  A text alone decides: its hash finds the verdict, and
    the id deals out equal texts.
    """
    keys = {"_id": F.coalesce(F.col("doc_id").try_cast("long"), F.lit(0).cast("long")),
            "_k1": F.xxhash64("text"), "_k2": F.xxhash64(F.lit(1), "text")}
    keyed = docs.withColumns(keys)
    kept = judged(keyed.select(*keys, "text"), least, keep_text=False).filter("kept").select(*keys)
    return keyed.join(kept, [*keys], "left_semi").drop(*keys)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality(docs: DataFrame) -> DataFrame:
    """One row per document: counts, base verdict, verdict and posterior."""
    return judged(docs.select("doc_id", "text"), keep_text=False).select(
        F.col("doc_id").cast("long"), *COUNTS, "base_failed", "kept", "posterior")
