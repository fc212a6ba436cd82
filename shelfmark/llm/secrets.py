"""Secret scans: fixed formats, and a battery of randomness tests.

Three formats are found as they are (``assign``, ``access``, ``hex``).  Beyond
them, every long run of encoding letters is a candidate (kind ``random``):

* its encoding (decimal, hex, base32, letters and digits, base64) is inferred
  from the letters it uses; dictionary-like runs infer a one-case alphabet;
* what is not random is learned from the corpus itself: letter pairs of distinct
  words (of all whole texts), and of the distinct candidates of
  the same encoding, each counting once and never for itself.  The
  likelihood of the run under uniform letters over that under these pairs is
  its evidence; one over it bounds the p-value of "no more random than what the
  corpus holds" (Markov's inequality), so that small means random;
* three statistics hold it against random text of that encoding: chi-squared
  against uniform use of the alphabet, the number of runs above and below the
  alphabet's middle, and the correlation of neighbouring letters.  Together
  (Fisher's method) they must not speak against it, else its p-value is one;
* Benjamini-Hochberg bounds the share of false finds over the whole corpus,
  separately in strata of length and encoding, because short runs carry little
  evidence and would otherwise decide the threshold for the long ones.

P-values are counted on a fixed grid, so the thresholds come from a table of
bounded size; its end is far below what any number of candidates asks for.  All of it is built-in column functions.

Null texts are empty; texts without a find have no spans; repeated rows have the
same spans (each row counts as a candidate of its own).  Positions are code
points.  An empty table returns no rows.  Extra columns pass through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import stored, whole_text

KINDS = ("assign", "access", "hex", "random")
#: The three formats and their least sizes.
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]{16,}"  # a run of 16 or more is the same as a whole run of that size
LEAST = {"assign": 12, "access": 18, "hex": 16}
CANDIDATE = "[A-Za-z0-9+/_-]{20,}"
#: (encoding, letters in order, pattern): the first that fits.
ENCODINGS = (
    ("decimal", "0123456789", "^[0-9]+$"),
    ("hex", "0123456789abcdef", "^[0-9a-f]+$"),
    ("upper_hex", "0123456789ABCDEF", "^[0-9A-F]+$"),
    ("lower", "abcdefghijklmnopqrstuvwxyz", "^[a-z]+$"),
    ("capital", "abcdefghijklmnopqrstuvwxyz", "^[A-Z]?[a-z]+$"),
    ("base32", "234567ABCDEFGHIJKLMNOPQRSTUVWXYZ", "^[A-Z2-7]+$"),
    ("lower_digit", "0123456789abcdefghijklmnopqrstuvwxyz", "^[0-9a-z]+$"),
    ("letters_digits", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "^[0-9A-Za-z]+$"),
    ("base64", "+-/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz", ""),
)
CAPITAL = 4
#: Letters of text, cases as one, and how often each is met where nothing was read yet (a hundred thousandths).
FOLDED = "0123456789abcdefghijklmnopqrstuvwxyz+-/_"
USUAL = (*[800] * 10, 8167, 1492, 2782, 4253, 12702, 2228, 2015, 6094, 6966, 153, 772, 4025, 2406, 6749, 7507, 1929, 95, 5987, 6327, 9056,
         2758, 978, 2360, 150, 1974, 74, *[300] * 4)
#: Letters read that weigh as much as that; pairs that weigh as much as single letters; candidates, as text around them.
USUAL_LETTERS, USUAL_PAIRS, USUAL_RUNS = 1000, 20, 2
#: A candidate counts once, in parts of this.
WEIGHT = 1 << 30
#: The three statistics speak against uniform letters below this probability.
UNEVEN = 0.001
#: Share of false finds allowed; p-values are counted in this many steps to a power of ten, up to GRID of them.
FALSE_SHARE, STEPS, GRID = 0.05, 50, 2000

SPAN = "array<struct<start:int,end:int>>"


def found(text: Column, pieces: Column, matches: Column, ok) -> Column:
    """Spans of matches, from what stands between them; ``ok(match number)`` keeps one."""
    start = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("out", T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")).cast(start)

    def step(a: Column, i: Column) -> Column:
        begin = a["at"] + F.length(F.get(pieces, i))
        end = begin + F.length(F.get(matches, i))
        span = F.struct(begin.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(ok(i), F.array_append(a["out"], span)).otherwise(a["out"]).alias("out")).cast(start)

    n = F.size(matches)
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), zero, step)["out"]).otherwise(F.array().cast(SPAN))


def normal_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by the usual five-term approximation."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with arrays of spans for the three formats, and candidate runs with their letters."""
    text, d = whole_text(), docs
    for kind, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("random", CANDIDATE)):
        # A quick look first: most texts hold no match at all.
        has = text.rlike(pattern)
        d = d.withColumns({f"_{kind}_between": F.when(has, F.split(text, pattern, -1)),
                           f"_{kind}": F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))})
    d = d.withColumn("_value", F.when(F.col("_assign").isNotNull(), F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))))
    col, none = F.col, F.array().cast(SPAN)
    long = lambda name, kind: (lambda i: F.length(F.get(col(name), i)) >= LEAST[kind])
    spans = {
        "assign": found(text, col("_assign_between"), col("_assign"), long("_value", "assign")),
        "access": found(text, col("_access_between"), col("_access"), long("_access", "access")),
        "hex": found(text, col("_hex_between"), col("_hex"), long("_hex", "hex")),
        "runs": found(text, col("_random_between"), col("_random"), lambda i: F.lit(True))}
    d = d.withColumns({f"spans_{k}": F.coalesce(v, none) for k, v in spans.items()})
    base = F.concat(*[col(f"spans_{k}") for k in ("assign", "access", "hex")])
    clear = lambda r: ~F.exists(base, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))
    d = d.withColumn("candidates", F.filter(F.transform(col("spans_runs"), lambda s, i: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.get(col("_random"), i).alias("run"))), clear))
    return d.drop("spans_runs", "_value", *[f"_{k}{x}" for k in KINDS for x in ("", "_between")])


def encoded(candidates: Column) -> Column:
    """Each candidate with the number of its encoding, in the letters of that encoding."""

    def letters(c: Column) -> Column:
        run, e = c["run"], F.lit(len(ENCODINGS) - 1)
        for k in reversed(range(len(ENCODINGS) - 1)):
            e = F.when(run.rlike(ENCODINGS[k][2]), k).otherwise(e)
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), e.alias("e"), F.when(
            e == CAPITAL, F.lower(run)).otherwise(run).alias("run"))

    return F.transform(candidates, letters)


def places(run: Column, e: Column) -> Column:
    """Where each letter stands in its alphabet, from 1."""
    letters_of = F.get(F.array(*[F.lit(a) for _, a, _ in ENCODINGS]), e)
    return F.transform(F.split(run, ""), lambda x: F.call_function("instr", letters_of, x))


def pairs_of(v: Column) -> Column:
    """Neighbouring letters, each pair as one number."""
    return F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: 100 * a + b)


def text_pairs(docs: DataFrame) -> np.ndarray:
    """Pairs of letters in the distinct words of all whole texts, too short to be candidates."""
    words = F.split(F.lower(whole_text()), "[^0-9a-z+/_-]+")
    words = docs.select(F.explode(words).alias("word")).filter(F.length("word").between(2, 19)).distinct()
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, 2)))
    counts = words.select(pair.alias("pair")).groupBy("pair").count()
    out = np.zeros((len(FOLDED), len(FOLDED)))
    for r in counts.collect():  # 40 x 40 at most
        out[FOLDED.index(r["pair"][0]), FOLDED.index(r["pair"][1])] = r["count"]
    return out


def run_pairs(table: DataFrame) -> dict[int, np.ndarray]:
    """Pairs of letters in the distinct candidates of each encoding; a candidate counts one in all."""
    runs = table.select(F.explode("candidates").alias("c")).select("c.e", "c.run").distinct()
    each = runs.select("e", F.round(WEIGHT / (F.length("run") - 1)).cast("long").alias("w"), F.explode(pairs_of(places(F.col("run"), F.col("e")))).alias("pair"))
    out: dict[int, np.ndarray] = {}
    for r in each.groupBy("e", "pair").agg(F.sum("w").alias("w")).collect():  # an alphabet's square at most
        k = len(ENCODINGS[r["e"]][1])
        out.setdefault(r["e"], np.zeros((k, k)))[r["pair"] // 100 - 1, r["pair"] % 100 - 1] = r["w"] / WEIGHT
    return out


def usual(text: np.ndarray, runs: dict[int, np.ndarray]) -> tuple[dict[int, int], np.ndarray, np.ndarray]:
    """Where each encoding's pairs begin; how often each pair is met, as a multiple of chance; what of it one candidate makes.

    Half of it is the text's own, so that an encoding that only keys use doesn't make keys usual.
    """
    single = text.sum(0) + USUAL_LETTERS * np.array(USUAL) / sum(USUAL)
    single /= single.sum()
    pairs = (text + USUAL_PAIRS * single) / (text.sum(1, keepdims=True) + USUAL_PAIRS)
    begin, met, own, at = {}, [np.zeros(0)], [np.zeros(0)], 0
    for e, counts in sorted(runs.items()):
        fold = [FOLDED.index(x) for x in ENCODINGS[e][1].lower()]
        around = pairs[np.ix_(fold, fold)] / np.bincount(fold)[fold]
        around /= around.sum(1, keepdims=True)
        seen = counts.sum(1, keepdims=True) + USUAL_RUNS
        k, begin[e] = len(fold), at
        met.append((k / 2 * (around + (counts + USUAL_RUNS * around) / seen)).ravel())
        own.append(np.broadcast_to(k / 2 / seen, (k, k)).ravel())
        at += k * k
    return begin, np.concatenate(met), np.concatenate(own)


def constant(values: np.ndarray) -> Column:
    return F.split(F.lit(",".join(f"{x:.6g}" for x in values)), ",").cast("array<double>")


def tested(candidates: Column, begin: dict[int, int], met: Column, own: Column) -> Column:
    """Each candidate with its stratum and the grid step of its p-value (large: random)."""
    pair = lambda a, b: F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 2, F.size(a)), b)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    begins = F.array(*[F.lit(begin.get(e, 0)) for e in range(len(ENCODINGS))])
    state = T.StructType([T.StructField("pair", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("sum", T.DoubleType())])

    def coded(c: Column) -> Column:
        letters_of = F.get(F.array(*[F.lit(a) for _, a, _ in ENCODINGS]), c["e"])
        v = places(c["run"], c["e"])
        return F.struct(
            c["start"].alias("start"), c["end"].alias("end"), c["e"].alias("e"), F.get(begins, c["e"]).alias("begin"),
            F.length(letters_of).cast("double").alias("k"), F.length(c["run"]).cast("double").alias("n"),
            F.array_sort(pairs_of(v)).alias("pairs"), v.cast("array<double>").alias("v"))

    def summed(c: Column) -> Column:
        v, middle, k = c["v"], (c["k"] + 1) / 2, c["k"].cast("int")
        squares = total(F.transform(F.array_distinct(v), lambda x: F.pow(F.size(F.filter(v, lambda y: y == x)).cast("double"), F.lit(2.0))))

        def evidence(a: Column) -> Column:  # of all of a pair's places; the candidate's own share of the counts is taken out
            i = c["begin"] + (F.floor(a["pair"] / 100).cast("int") - 1) * k + a["pair"] % 100 - 1
            usual_ = F.get(met, i) - F.get(own, i) * a["n"] / (c["n"] - 1)
            return F.when(a["n"] > 0, a["sum"] - a["n"] * F.log(F.greatest(usual_, F.lit(1e-9)))).otherwise(a["sum"])

        def step(a: Column, x: Column) -> Column:
            same = a["pair"] == x
            return F.struct(x.alias("pair"), F.when(same, a["n"] + 1).otherwise(1).alias("n"),
                            F.when(same, a["sum"]).otherwise(evidence(a)).alias("sum")).cast(state)

        zero = F.struct(F.lit(0).alias("pair"), F.lit(0).alias("n"), F.lit(0.0).alias("sum")).cast(state)
        return F.struct(
            *[c[x].alias(x) for x in ("start", "end", "e", "k", "n", "v")], (total(v) / c["n"]).alias("mean"),
            F.aggregate(c["pairs"], zero, step, evidence).alias("evidence"),
            (c["k"] / c["n"] * squares - c["n"]).alias("chi"),
            F.size(F.filter(v, lambda x: x > middle)).cast("double").alias("high"),
            (1.0 + total(pair(v, lambda a, b: F.when((a > middle) != (b > middle), 1.0).otherwise(0.0)))).alias("runs"))

    def judged(c: Column) -> Column:
        n, m, free = c["n"], c["mean"], c["k"] - 1
        logs = lambda p: -F.log(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-30)))
        uneven = logs(normal_tail((c["chi"] - free) / F.sqrt(2 * free * (n - 1) / n)))
        both = 2 * c["high"] * (n - c["high"])
        spread = F.sqrt(F.greatest(both * (both - n) / (n * n * (n - 1)), F.lit(1e-9)))
        runs = logs(F.when(both > n, 2 * normal_tail(F.abs(c["runs"] - 1 - both / n) / spread)).otherwise(0.0))
        var = total(F.transform(c["v"], lambda x: (x - m) * (x - m)))
        serial = logs(F.when(var > 0, 2 * normal_tail(F.abs(total(pair(c["v"], lambda a, b: (a - m) * (b - m))) / var + 1 / n)
                                                      * F.sqrt(n))).otherwise(0.0))
        x = uneven + runs + serial
        even = F.exp(-x) * (1 + x + x * x / 2) >= UNEVEN  # chi-squared of six degrees
        step = F.when(even, F.floor(STEPS * c["evidence"] / F.log(F.lit(10.0)))).otherwise(0)
        return F.struct(c["start"].alias("start"), c["end"].alias("end"),
                        (c["e"] * 64 + F.floor(F.log2(n))).cast("int").alias("stratum"),
                        F.least(F.greatest(step, F.lit(0)), F.lit(GRID)).cast("int").alias("step"))

    out = candidates
    for f in (coded, summed, judged):
        out = F.transform(out, f)
    return out


def thresholds(counts: list[tuple[int, int, int]], false_share: float = FALSE_SHARE) -> dict[int, int]:
    """Benjamini-Hochberg on the grid: for each stratum the least step that counts as random, if any.

    ``counts``: (stratum, step, candidates).  A step's p-value is the largest that falls on it.
    """
    out: dict[int, int] = {}
    for stratum in sorted({s for s, _, _ in counts}):
        steps = sorted(((step, n) for s, step, n in counts if s == stratum), reverse=True)
        m, above = sum(n for _, n in steps), 0
        for step, n in steps:
            above += n
            if 10 ** (-step / STEPS) <= false_share * above / m:
                out[stratum] = step
    return out


def scanned(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``spans_assign``, ``spans_access``, ``spans_hex`` and ``spans_random``."""
    table = with_spans(docs)
    table = table.withColumn("candidates", F.when(F.size("candidates") > 0, encoded(F.col("candidates"))))
    table = stored(table if keep_text else table.drop("text"), "spans")
    runs = run_pairs(table)
    if not runs:
        return table.withColumn("spans_random", F.array().cast(SPAN)).drop("candidates")
    begin, met, own = usual(text_pairs(docs), runs)
    # One row of two arrays, of the alphabets' squares together, stands beside every row.
    pairs = stored(table.sparkSession.range(1).select(constant(met).alias("_met"), constant(own).alias("_own")), "pairs")
    table = table.crossJoin(F.broadcast(pairs)).withColumn("tested", F.when(F.col("candidates").isNotNull(), tested(
        F.col("candidates"), begin, F.col("_met"), F.col("_own")))).drop("candidates", "_met", "_own")
    # A stratum is an encoding and a power of two, a step one of GRID + 1: the table is bounded.
    counts = (table.select(F.explode("tested").alias("t")).groupBy("t.stratum", "t.step").count().collect())
    least = thresholds([(r["stratum"], r["step"], r["count"]) for r in counts])
    none = F.array().cast(SPAN)
    if least:
        limits = F.create_map(*[F.lit(x) for pair in sorted(least.items()) for x in pair])
        passed = F.filter(F.col("tested"), lambda t: F.coalesce(t["step"] >= F.element_at(limits, t["stratum"]), F.lit(False)))
        random = F.coalesce(F.transform(passed, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))), none)
    else:
        random = none
    return table.withColumn("spans_random", random).drop("tested")


def labelled(kinds: tuple[str, ...]) -> Column:
    """All spans of some kinds as ``kind:start:end``, by start, then kind as listed."""
    ranked = lambda rank: lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("kind"), s["end"].alias("end"))
    spans = F.array_sort(F.concat(*[F.transform(f"spans_{k}", ranked(KINDS.index(k))) for k in kinds]))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redacted(docs: DataFrame, mark: str = "<SECRET>") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``mark`` (overlapping spans by one); other texts unchanged."""
    d = scanned(docs)
    spans = F.array_sort(F.concat(*[F.col(f"spans_{k}") for k in KINDS]))
    kind = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("parts", T.ArrayType(T.StringType()))])
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")).cast(kind)

    def step(a: Column, s: Column) -> Column:
        inside = s["start"] < a["at"]
        part = F.concat(F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.lit(mark))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"),
                        F.when(inside, a["parts"]).otherwise(F.array_append(a["parts"], part)).alias("parts")).cast(kind)

    d = d.withColumn("_spans", spans).withColumn("_parts", F.when(F.size("_spans") > 0, F.aggregate(F.col("_spans"), zero, step)))
    rest = F.substring(F.col("text"), F.col("_parts.at") + 1, F.length("text"))
    text = F.when(F.col("_parts").isNotNull(), F.concat(F.array_join("_parts.parts", ""), rest)).otherwise(F.col("text"))
    return d.withColumn("text", text).select(*docs.columns)


def secrets(docs: DataFrame) -> DataFrame:
    """One row per document: counts by format, digest of the base spans, and all spans."""
    d = scanned(docs.select("doc_id", "text"), keep_text=False)
    return d.select(
        F.col("doc_id").cast("long"), *[F.size(f"spans_{k}").cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(labelled(KINDS[:3]), 256).alias("base_sha256"), labelled(KINDS).alias("spans"),
        F.size("spans_random").cast("long").alias("n_random"))
