"""Quality rules with risk-controlled thresholds (native).

Fixed base rules reject a document outright. On top of them each rule (a metric of the text, the larger the worse) has cutoffs, and labelled
holdout rows settle which of them act in a stratum. All rules are tested as one, on the good rows that any of them rejects: a sequence of steps
tightens rule after rule, from the mildest cutoff on, in the order of SEQUENCE, and a step is safe if the exact binomial tail
P(Bin(n, alpha) <= k) is at most the level, where n is the number of good labelled rows of the stratum and k how many of them the step would
reject. Testing stops at the first step that isn't safe (fixed-sequence testing), so a sequence needs no correction within itself, and
delta is shared equally by all sequences (Bonferroni over the strata, the languages and the whole): with confidence 1 - delta no group
loses more than max_false_rejection of its good rows to its own setting.

A stratum with too few good rows to certify anything even without a false rejection takes its language's setting, and a language with too few
that of the whole; it then has the bound of what it takes the setting from (at most that share of the language's good rows, or of all), none of its
own. certified_by names it for every row: stratum, language, all, or null where no cutoff acts. A group with enough rows that fails its tests takes
nothing, nor do other languages than the listed ones and those without a good row take the setting of the whole. Without enough labelled
rows nothing is certified and only the base rules act.

Everything runs in DataFrame functions: one scan computes the metrics, one aggregate the counts (at most strata x rules x cutoffs
rows), and the certified cutoffs (at most one row for each stratum) are broadcast; strata are a fixed list, so the size is bounded.

Edge cases: null or empty text has no words and fails the base rules; a null doc_id keeps its row and never matches a label; several
labels of a document count as good if any is; repeated rows are judged alike; extra columns are ignored by metrics() and kept by apply().
Windows are told apart by their 64-bit XXH64 within one document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, SPACE_RUN, WORD, cut, let, table

SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
#: The order in which certify() tightens rules; repeats come last, as a base rule bounds them already.
SEQUENCE = ("symbol_share", "mean_word", "dup_line_share", "repeat_share")


@dataclass(frozen=True)
class Params:
    min_words: int = 20
    max_repeat_percent: int = 30
    max_false_rejection: float = 0.02
    delta: float = 0.05
    languages: tuple[str, ...] = ("en", "de", "fr", "es")
    #: Word counts at which a new length band starts.
    bands: tuple[int, ...] = (150, 500)
    #: Cutoffs of each rule, mildest first: a document with a metric above the cutoff is rejected.
    cutoffs: tuple[tuple[str, tuple[float, ...]], ...] = (
        ("symbol_share", (2.0, 1.0, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05)),
        ("dup_line_share", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)),
        ("repeat_share", (0.28, 0.25, 0.2, 0.15, 0.1)),
        ("mean_word", (12.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0)),
    )


DEFAULT = Params()


def repeat_words(words: Column, width: int = REPEAT_WINDOW) -> Column:
    """Words of an array that lie in a window of width words (a power of two) found twice or more in it."""
    w = F.lit(width)
    last = F.size(words) - w + 1

    def doubled(h: Column, step: int) -> Column:
        """Hashes of windows of 2 * step words, from those of step words; the last ones reach past the end."""
        return let(h, lambda x: F.zip_with(x, F.slice(x, F.lit(1 + step), F.size(x)), lambda a, b: F.xxhash64(a, b)))

    hashes, step = F.transform(words, lambda x: F.xxhash64(x)), 1
    while step < width:
        hashes, step = doubled(hashes, step), 2 * step
    hashes = F.slice(hashes, F.lit(1), last)

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda x, i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
            again = F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda x, i: F.least(w, F.coalesce(F.get(p, i + 1) - x, w)))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return let(let(ordered, starts), total)

    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) < w + 1, F.lit(0)).otherwise(counted)


def metrics(docs: DataFrame, p: Params = DEFAULT, text: str = "text") -> DataFrame:
    """docs with the base metrics added: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(t, F.lit(SPACE))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    symbols = F.when(t.rlike("[" + SYMBOLS + "]"), F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).otherwise(0)
    n_and_repeats = let(
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN)),
        lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("c"), repeat_words(w).cast("long").alias("r")),
    )
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    out = docs.withColumns({"__w": n_and_repeats, "__l": line_counts, "n_symbols": symbols.cast("long")})
    out = out.withColumns({"n_words": F.col("__w.n"), "word_chars": F.col("__w.c"), "n_repeat_words": F.col("__w.r"), "n_lines": F.col("__l.n"), "n_dup_lines": F.col("__l.d")}).drop("__w", "__l")
    return out.withColumn("base_failed", (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > p.max_repeat_percent * F.col("n_words")))


def rule_values() -> dict[str, Column]:
    """The value of each rule, from the metrics; larger is worse."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {"symbol_share": F.col("n_symbols") / words, "dup_line_share": F.col("n_dup_lines") / lines, "repeat_share": F.col("n_repeat_words") / words, "mean_word": F.col("word_chars") / words}


def stratum(p: Params = DEFAULT, lang: str = "lang") -> Column:
    """Language (of a fixed list, or other) and length band."""
    band = F.lit(0)
    for x in p.bands:
        band = band + (F.col("n_words") >= x).cast("int")
    return F.concat(F.when(F.col(lang).isin(*p.languages), F.col(lang)).otherwise(F.lit("other")), F.lit(":"), band.cast("string"))


def log_gamma(x: Column) -> Column:
    """ln Gamma for x >= 1: Stirling's series after a shift by 10."""
    z = x + 10.0
    product = x
    for i in range(1, 10):
        product = product * (x + float(i))
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - F.log(product)


def binomial_tail(n: Column, k: Column, alpha: float) -> Column:
    """P(Bin(n, alpha) <= k), exact up to rounding; 1 where k is at or above the mean. Terms beyond 40 deviations below k, under 1e-300, are left out."""
    n, k = n.cast("double"), k.cast("double")
    least = F.greatest(F.lit(0.0), k - 60.0 - 40.0 * F.sqrt(n * alpha)).cast("long")
    term = lambda i: F.exp(log_gamma(n + 1.0) - log_gamma(i + 1.0) - log_gamma(n - i + 1.0) + i * F.log(F.lit(alpha)) + (n - i) * F.log(F.lit(1.0 - alpha)))
    total = F.aggregate(F.sequence(least, k.cast("long")), F.lit(0.0), lambda a, i: a + term(i.cast("double")))
    return F.when(k >= n * alpha, F.lit(1.0)).otherwise(total)


def certify(measured: DataFrame, labels: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """A row for each stratum: certified_by and, for each rule, its cutoff, or null where none acts."""
    values, cutoffs = rule_values(), dict(p.cutoffs)
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("__q")).filter("__q = 1").select("doc_id")
    # the first step of the sequence that rejects the row; cutoffs fall, so the later ones reject it too
    rules = sorted(cutoffs, key=lambda r: SEQUENCE.index(r))
    begin = {r: sum(len(cutoffs[x]) for x in rules[:i]) for i, r in enumerate(rules)}
    steps = sum(map(len, cutoffs.values()))
    first = F.least(F.lit(steps), *[F.when(values[r] > c, begin[r] + j).otherwise(steps) for r in rules for j, c in enumerate(cutoffs[r])])
    s = stratum(p)
    groups = F.array(s, F.substring_index(s, ":", 1), F.lit("all"))
    held = measured.filter(~F.col("base_failed")).select("doc_id", groups.alias("groups"), first.alias("first")).join(good, "doc_id")
    counts = held.select(F.explode("groups").alias("g"), "first").groupBy("g", "first").agg(F.count("*").alias("n"))
    by = counts.groupBy("g").agg(F.sum("n").alias("total"), F.collect_list(F.struct("first", "n")).alias("by"))
    level = p.delta / ((len(p.languages) + 1) * (len(p.bands) + 1) + len(p.languages) + 2)
    rejected = F.aggregate("by", F.lit(0).cast("long"), lambda a, x: a + F.when(x["first"] <= F.col("step"), x["n"]).otherwise(0))
    grid = by.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("tail", binomial_tail(F.col("total"), rejected, p.max_false_rejection))
    # tails grow along the sequence, so the last safe step has only safe ones before it; -1: none though there are rows enough, null: too few
    enough = F.pow(F.lit(1.0 - p.max_false_rejection), F.col("total")) <= level
    last = grid.groupBy("g").agg(F.max(F.when(enough, F.when(F.col("tail") <= level, F.col("step")).otherwise(-1))).alias("last"))
    found = last.agg(F.map_from_entries(F.collect_list(F.struct("g", "last"))).alias("found"))
    names = [(x, f"{x}:{b}") for x in (*p.languages, "other") for b in range(len(p.bands) + 1)]
    each = found.select("found", F.explode(F.array(*[F.struct(F.lit(x).alias("lang"), F.lit(name).alias("stratum")) for x, name in names])).alias("s"))
    whole = (F.col("s.lang") != "other") & F.map_contains_key("found", F.col("s.lang"))
    own, of_language, of_all = F.col("found")[F.col("s.stratum")], F.col("found")[F.col("s.lang")], F.when(whole, F.col("found")["all"])
    by_whom = F.when(own.isNotNull(), "stratum").when(of_language.isNotNull(), "language").when(of_all.isNotNull(), "all")
    settled = each.select("s.stratum", by_whom.alias("by_whom"), F.coalesce(own, of_language, of_all, F.lit(-1)).alias("last"))
    cut_of = lambda r: F.when(F.col("last") >= begin[r], F.element_at(F.array(*[F.lit(float(c)) for c in cutoffs[r]]), F.least(F.col("last") - begin[r] + 1, F.lit(len(cutoffs[r])))))
    return settled.select("stratum", F.when(F.col("last") >= 0, F.col("by_whom")).alias("certified_by"), *[cut_of(r).alias(f"__cut_{r}") for r, _ in p.cutoffs])


def decide(measured: DataFrame, cutoffs: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """measured with kept, failed_rules and certified_by added. cutoffs has at most one row for each stratum of the fixed list, so it is broadcast."""
    values = rule_values()
    joined = measured.withColumn("__s", stratum(p)).join(F.broadcast(cutoffs.withColumnRenamed("stratum", "__s")), "__s", "left")
    failed = F.array_compact(F.array(*[F.when(values[r] > F.col(f"__cut_{r}"), F.lit(r)) for r, _ in p.cutoffs]))
    return joined.withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("__s", *[f"__cut_{r}" for r, _ in p.cutoffs])


def judge(docs: DataFrame, labels: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """A row for each document: doc_id, the metrics, base_failed, failed_rules, certified_by and kept."""
    measured = cut(metrics(docs.select("doc_id", "lang", "text"), p).drop("text"), "quality-metrics")
    return decide(measured, certify(measured, labels, p), p)


def keep(docs: DataFrame, labels: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The rows of docs that all rules keep, with docs' own columns."""
    mine = ["n_words", "n_repeat_words", "n_lines", "n_dup_lines", "word_chars", "n_symbols", "base_failed"]
    packed = docs.select(F.struct("*").alias("__row"), "doc_id", "lang", "text")
    measured = cut(metrics(packed, p).drop("text"), "quality-rows")
    kept = decide(measured, certify(measured.select("doc_id", "lang", *mine), labels, p), p)
    return kept.filter("kept").select("__row.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "certified_by")
