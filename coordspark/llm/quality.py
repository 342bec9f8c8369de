"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Every document gets counts (words, symbols, repeated lines, words in repeated 3-word windows) and signals. Labelled
documents are split by a hash of their id. A third of them designs a rule for each stratum (language): each signal's
cutoff, of a fixed grid, with the best balance of bad against good rejections, if that is positive. The others are the
holdout, on which rules are certified: the designed cutoffs, all raised by d places on the grid, for d from 5 down to
0, are hypotheses "this rule rejects more than ``RISK`` of the good documents", tested in this order by exact binomial
tails at ``DELTA`` / number of strata (Bonferroni over strata; within one the fixed sequence needs no correction, as it
ends with the first rule that does not pass). Of the certified rules the one with the best balance on the holdout is
used. So, with probability 1 - ``DELTA``, in no stratum more than ``RISK`` of the good documents are rejected by the signals. A
stratum needs about ``labels_needed`` good labels.

Defined results: a null text has no words and fails the base rules; a stratum with few labels gets no cutoffs and
keeps its documents (base rules apart); a null language is the stratum ``und``; a document with several labels is
good if all are good; null labels are ignored; repeated rows are judged alike, and a labelled document counts once in the
holdout of a stratum, whatever its number of rows; an empty table gives an empty result;
extra columns are ignored; texts of any length are counted whole.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coordspark.llm.common import drop, save, small

RISK = 0.05
DELTA = 0.05
#: How many bad documents a cutoff must reject for each good one.
WEIGHT = 20
MIN_WORDS = 50
REPEAT_PERCENT = 50

#: One in so many labelled documents designs the rules, the others certify them.
DESIGN = 3
#: Low bits of a packed window that hold its place in the text; the others are of its hash.
PLACE_BITS = 24

SPACE = r"[\x20\x09-\x0D]+"
_TRIM = " \t\n\x0b\x0c\r"

#: signal: (expression over the counts, cutoffs); a document is rejected if its signal is above the cutoff.
SIGNALS: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", (0.02, 0.03, 0.05, 0.08, 0.12, 0.2)),
    "shouting": ("n_upper / greatest(word_chars, 1)", (0.15, 0.2, 0.3, 0.4, 0.5, 0.6)),
    "exclamations": ("n_marks / greatest(n_words, 1)", (0.1, 0.2, 0.4, 0.8, 1.2, 1.6)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.1, 0.2, 0.3, 0.4, 0.5, 0.6)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.1, 0.15, 0.2, 0.25, 0.3, 0.4)),
    "few_words": ("1 - n_distinct / greatest(n_words, 1)", (0.6, 0.7, 0.75, 0.8, 0.85, 0.9)),
    "long_words": ("word_chars / greatest(n_words, 1)", (9.0, 10.0, 11.0, 12.0, 15.0, 20.0)),
    "short_words": ("-word_chars / greatest(n_words, 1)", (-4.0, -3.5, -3.0, -2.5, -2.0, -1.5)),
}


def _count(text: Column, characters: str) -> Column:
    """How often ASCII characters occur in a text."""
    return sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in characters), F.lit(0)).cast("bigint")


def _repeated_places(w: Column, n: Column) -> Column:
    """Places of words in 3-word windows that occur twice or more, by comparing the windows themselves."""
    pairs = F.zip_with(F.slice(w, 1, n - 2), F.slice(w, 2, n - 2), lambda a, b: F.concat_ws(" ", a, b))
    windows = F.zip_with(F.zip_with(pairs, F.slice(w, 3, n - 2), lambda a, b: F.concat_ws(" ", a, b)), F.sequence(F.lit(0), n - 3), lambda g, p: F.struct(g.alias("g"), p.alias("p")))
    s = F.sort_array(windows)
    both = F.zip_with(F.slice(s, 1, n - 3), F.slice(s, 2, n - 3), lambda a, b: F.when(a.g == b.g, F.array(a.p, a.p + 1, a.p + 2, b.p, b.p + 1, b.p + 2)))
    return F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull())))


def counts(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, stratum and the counts of each document's whole text, and the ``carried`` columns. One pass, no shuffle, O(n log n) in a text's words."""
    plain = docs.select(F.col("doc_id"), F.coalesce(F.col("lang"), F.lit("und")).alias("stratum"), F.coalesce(F.col("text"), F.lit("")).alias("t"), *carried)
    trimmed, t = F.btrim("t", F.lit(_TRIM)), F.col("t")
    words = plain.select(
        *carried,
        "doc_id",
        "stratum",
        F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE)).otherwise(F.array().cast("array<string>")).alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"),
        _count(t, "#*$%&|<>").alias("n_symbols"),
        F.length(F.regexp_replace("t", r"[^\p{Lu}]+", "")).cast("bigint").alias("n_upper"),
        _count(t, "!?").alias("n_marks"),
    )
    # 3-word windows as one number each, hash and place, so that sorting them is fast; equal neighbours are compared word by word
    w, n, low = F.col("w"), F.size("w"), (1 << PLACE_BITS) - 1
    packed = F.transform(F.sequence(F.lit(0), n - 3), lambda p: F.xxhash64(w[p], w[p + 1], w[p + 2]).bitwiseAND(~low).bitwiseOR(p.cast("bigint")))
    stacked = words.select(
        *carried, "doc_id", "stratum", "n_symbols", "n_upper", "n_marks", "w",
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        n.cast("bigint").alias("n_words"),
        F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"),
        F.size("l").cast("bigint").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("bigint").alias("n_dup_lines"),
        F.when((n >= 4) & (n <= low), F.sort_array(packed)).alias("s"),
    )

    def places(a: Column, b: Column) -> Column:
        p, q = a.bitwiseAND(low).cast("int"), b.bitwiseAND(low).cast("int")
        same = (w[p] == w[q]) & (w[p + 1] == w[q + 1]) & (w[p + 2] == w[q + 2])
        return F.when(F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS), F.when(same, F.array(p, p + 1, p + 2, q, q + 1, q + 2)).otherwise(F.array(F.lit(-1))))

    m = F.size("s")
    both = F.zip_with(F.slice("s", 1, m - 1), F.slice("s", 2, m - 1), places)
    stacked = stacked.withColumn("r", F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull()))))
    # where hashes of different windows are equal, or places do not fit, the windows themselves are sorted
    unsure = F.col("s").isNull() | F.array_contains("r", -1)
    repeated = F.when(F.col("n_words") < 4, F.lit(0)).when(unsure, F.size(_repeated_places(w, n))).otherwise(F.size("r"))
    return stacked.withColumn("n_repeat_words", repeated.cast("bigint")).drop("s", "r", "w")


def _log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1, by Stirling's series eight places higher."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * log(6.283185307179586) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    low = F.lit(0.0)
    for i in range(8):
        low = low + F.log(x + i)
    return series - low


def binomial_tail(k: Column, n: Column, rate: float, terms: int = 4000) -> Column:
    """P(X <= k) for X ~ Binomial(n, rate), exact up to rounding; 1 if k is not below the mean. What is left after ``terms`` terms is bounded from above."""
    k, n = k.cast("double"), n.cast("double")
    top = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * log(rate) + (n - k) * F.log1p(F.lit(-rate))
    odds = (1 - rate) / rate
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"), k.alias("j"), F.lit(0.0).alias("r"))

    def step(acc, _):
        r = acc.j / (n - acc.j + 1) * odds
        return F.struct((acc.term * r).alias("term"), (acc["sum"] + acc.term * r).alias("sum"), (acc.j - 1).alias("j"), r.alias("r"))

    folded = F.aggregate(F.slice(F.sequence(F.lit(0), F.least(k, F.lit(float(terms))).cast("int")), 2, terms), start, step, lambda acc: acc["sum"] + F.when(acc.j > 0, acc.term * acc.r / (1 - acc.r)).otherwise(0.0))
    return F.when(k < n * rate, F.least(F.exp(top) * folded, F.lit(1.0))).otherwise(1.0)


def labels_needed(strata: int, risk: float = RISK, delta: float = DELTA) -> int:
    """The least number of good labels of a stratum for which a rule that rejects none of them is certified."""
    holdout = ceil(log(delta / strata) / log(1 - risk))
    return ceil(holdout * DESIGN / (DESIGN - 1))


def certified_cutoffs(signals: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, weight: float = WEIGHT, grid=SIGNALS) -> DataFrame:
    """stratum and a column for each signal with its cutoff, or null: the certified rule of each stratum that has one."""
    marks = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    # a value's level is the number of cutoffs that it is above
    level = {name: sum(((F.col(name) > c).cast("int") for c in cutoffs[1:]), (F.col(name) > cutoffs[0]).cast("int")) for name, (_, cutoffs) in grid.items()}
    places = max(len(c) for _, c in grid.values())
    # a labelled document counts once in a stratum, however many rows it has: as rejected where any of them is
    labelled = signals.join(marks, "doc_id").groupBy("doc_id", "stratum", "good").agg(*(F.max(x).alias(name) for name, x in level.items()))
    held = save(labelled.select("stratum", "good", (F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(DESIGN)) == 0).alias("design"), *grid), "quality-held")
    good, bad = F.count_if(F.col("good") == 1), F.count_if(F.col("good") == 0)
    # design: the balance of each cutoff
    rows = held.where("design").select("stratum", "good", F.inline(F.array(*(F.struct(F.lit(name).alias("signal"), F.col(name).alias("level")) for name in grid))))
    leveled = rows.groupBy("stratum", "signal", "level").agg(good.alias("g"), bad.alias("b"))
    balance = leveled.select("stratum", "signal", F.explode(F.sequence(F.lit(1), F.lit(places))).alias("at"), F.when(F.col("level") >= F.col("at"), F.col("b") - weight * F.col("g")).otherwise(0.0).alias("x"))
    best = balance.groupBy("stratum", "signal", "at").agg(F.sum("x").alias("x")).where("x > 0").groupBy("stratum", "signal").agg(F.max_by("at", F.struct("x", "at")).alias("at"))
    start = save(best.groupBy("stratum").pivot("signal", list(grid)).agg(F.first("at")), "quality-start")
    # holdout: how many places a document is above the designed cutoffs, by the signal that is furthest
    begun = small(start).select("stratum", *(F.col(name).alias(f"{name}_at") for name in grid))
    reach = F.greatest(*(F.coalesce(F.col(name) - F.col(f"{name}_at"), F.lit(-places)) for name in grid))
    reached = save(held.where("not design").join(begun, "stratum").groupBy("stratum", reach.alias("reach")).agg(good.alias("g"), bad.alias("b")), "quality-reach")
    strata = max(1, reached.select("stratum").distinct().count())
    hit = F.col("reach") >= F.col("d")
    tests = reached.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(places - 1)))).groupBy("stratum", "d").agg(F.sum("g").alias("n"), F.sum(F.when(hit, F.col("g")).otherwise(0)).alias("k"), F.sum(F.when(hit, F.col("b")).otherwise(0)).alias("caught"))
    tests = tests.withColumn("p", F.when(F.col("n") > 0, binomial_tail(F.col("k"), F.col("n"), risk)).otherwise(1.0))
    # the fixed sequence: a rule counts if it and all stricter ones pass (a stratum has `places` rows here)
    passed = tests.withColumn("worst", F.max("p").over(Window.partitionBy("stratum").orderBy(F.desc("d")))).where(F.col("worst") * strata <= delta)
    gain = F.col("caught") - weight * F.col("k")
    chosen = passed.where(gain > 0).groupBy("stratum").agg(F.max_by("d", F.struct(gain, "d")).alias("d"))
    cutoff = lambda name: F.get(F.array(*(F.lit(float(c)) for c in grid[name][1])), F.col(name) + F.col("d") - 1)
    found = save(start.join(chosen, "stratum").select("stratum", *(cutoff(name).alias(name) for name in grid)), "quality-cutoffs")
    for df in (held, start, reached):
        drop(df)
    return found


def signalled(docs: DataFrame, *carried: str) -> DataFrame:
    """The counts of each document, its signals and the ``carried`` columns."""
    return counts(docs, *carried).withColumns({name: F.expr(expr).cast("double") for name, (expr, _) in SIGNALS.items()})


def verdicts(signals: DataFrame, limits: DataFrame, *carried: str) -> DataFrame:
    """The ``carried`` columns, doc_id, the counts, base_failed and kept, by the cutoffs of each stratum."""
    joined = signals.join(small(limits).select("stratum", *(F.col(name).alias(f"{name}_max") for name in SIGNALS)), "stratum", "left")
    above = F.lit(False)
    for name in SIGNALS:
        above = above | F.coalesce(F.col(name) > F.col(f"{name}_max"), F.lit(False))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    # one value of both: a filter on an "and" would be split and its first half pushed below the counts, which it would work out anew for each word
    return joined.select(*carried, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~F.greatest(failed, above)).alias("kept"))


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, carried: tuple[str, ...] = ()) -> DataFrame:
    """The ``carried`` columns, doc_id, the counts, base_failed and kept for every document."""
    signals = save(signalled(docs, *carried), "quality-signals")
    return verdicts(signals, certified_cutoffs(signals, labels, risk, delta), *carried)


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The documents that are kept, with all their columns. Each row goes by its own text, whatever its doc_id.

    The cutoffs are learned from stored counts without texts; the rows are then counted again as they pass, so that no copy of the corpus is stored.
    """
    signals = save(signalled(docs), "quality-signals")
    limits = certified_cutoffs(signals, labels, risk, delta)
    drop(signals)
    rows = docs.select("doc_id", "lang", "text", F.struct("*").alias("_row"))
    return verdicts(signalled(rows, "_row"), limits, "_row").where("kept").select("_row.*")
