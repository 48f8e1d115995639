"""Relational parts of model-based refinement: windows over tokens, choice of predictions, tag merging, softmax and the decision policy.

Scoring itself is pluggable: a scorer maps distinct (premise, hypothesis) pairs to probabilities. A scorer that fails ends the job; a text is never
passed on unmasked because a model was missing.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.functions.spans import let

from . import names

WINDOW, OVERLAP = 254, 48
PRIVATE = (0.80, 0.50)  # least entailment, least margin over the other two
PUBLIC = {"default": (0.80, 0.50), "education": (0.55, 0.10)}


def windows(docs: DataFrame, n_tokens: str = "n_tokens") -> DataFrame:
    """doc_id, window, first, last (token numbers, half open) that cover a document with overlap; the last window ends with it."""
    step = WINDOW - OVERLAP
    count = F.when(F.col(n_tokens) <= WINDOW, 1).otherwise(F.ceil((F.col(n_tokens) - WINDOW) / step) + 1)
    w = docs.filter(F.col(n_tokens) > 0).select("doc_id", n_tokens, F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))).alias("window"))
    return w.select("doc_id", "window", (F.col("window") * step).cast("long").alias("first"), F.least(F.col("window") * step + WINDOW, F.col(n_tokens)).cast("long").alias("last"))


def select_predictions(rows: DataFrame) -> DataFrame:
    """One prediction for each (doc_id, token): the most surrounding context (rank), then the earlier window."""
    w = W.partitionBy("doc_id", "token").orderBy(F.col("rank").desc(), "window")
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def merge_tags(rows: DataFrame) -> DataFrame:
    """Entities from B-/I-/O tags with offsets: a token continues the entity before it if it has the same label and is tagged I or touches it; score is the mean."""
    w = W.partitionBy("doc_id").orderBy("start", "stop")
    tagged = rows.filter("tag <> 'O'").withColumn("label", F.expr("substring(tag, 3)"))
    # O tokens between two tagged ones break the entity: compare token numbers, too
    joins = (F.lag("label").over(w) == F.col("label")) & (F.lag("token").over(w) == F.col("token") - 1) & (F.col("tag").startswith("I-") | (F.lag("stop").over(w) == F.col("start")))
    seq = tagged.withColumn("__new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("entity", F.sum("__new").over(w))
    return seq.groupBy("doc_id", "entity").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.first("label").alias("label"), F.avg("score").alias("score"))


def softmax(x: Column) -> Column:
    """Probabilities of an array of logits, shifted by their maximum; a logit that isn't finite is an error."""
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    shifted = let(F.array_max(x).cast("double"), lambda top: F.transform(x, lambda v: F.exp(v.cast("double") - top)))
    shares = let(shifted, lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(e, lambda v: v / total)))
    return F.when(odd, F.raise_error(F.lit("logits have to be finite")).cast("array<double>")).otherwise(shares)


def argmax(x: Column) -> Column:
    """Place (from 0) of the first largest element."""
    return F.array_position(x, F.array_max(x)) - 1


@F.pandas_udf(T.BooleanType())
def plausible(words: pd.Series) -> pd.Series:
    """Whether words, parted by white space, read as one name: parts in a known order, at most one of them an unknown capitalised word."""
    return pd.Series([bool(names.readings(w.split()) & {"whole", "open"}) for w in words], dtype=bool)


def join_names(spans: DataFrame, text: str = "text") -> DataFrame:
    """Neighbouring name spans with only white space between that are one name of two or three words, as one span each (in addition to the parts).

    Two whole people are never joined: their words don't read as one name."""
    w = W.partitionBy("doc_id").orderBy("start", "stop")
    nxt = spans.withColumns({"__s": F.lead("start").over(w), "__e": F.lead("stop").over(w)}).filter(F.col("__s") > F.col("stop"))
    piece = lambda a, b: F.substring(F.col(text), a + 1, b - a)
    near = nxt.filter(piece(F.col("stop"), F.col("__s")).rlike(r"(?U)^\s+$")).withColumn("__v", piece(F.col("start"), F.col("__e")))
    short = near.filter(F.size(F.split(F.col("__v"), r"(?U)\s+")).between(2, 3))
    return short.filter(plausible("__v")).select("doc_id", "start", F.col("__e").alias("stop"))


def decide(scores: DataFrame) -> DataFrame:
    """span_id, decision, reason from scores (span_id, hyp, kind, topic, entail, neutral, contra); kind is private or public, hyp the order of asking.

    A confident private answer protects, unless the passage is plain teaching material; else the first public answer that qualifies for its topic releases; else the span stays protected."""
    margin = F.col("entail") - F.greatest("neutral", "contra")
    education = F.col("topic") == "education"
    private = (F.col("kind") == "private") & (F.col("entail") >= PRIVATE[0]) & (margin >= PRIVATE[1]) & ~education
    least = lambda i: F.when(education, PUBLIC["education"][i]).otherwise(PUBLIC["default"][i])
    public = (F.col("kind") == "public") & (F.col("entail") >= least(0)) & (margin >= least(1))
    got = scores.groupBy("span_id").agg(F.max(private).alias("veto"), F.min(F.when(public, F.col("hyp"))).alias("first"))
    return got.select("span_id", F.when(F.col("veto"), "MASK").when(F.col("first").isNotNull(), "KEEP").otherwise("MASK").alias("decision"), F.when(F.col("veto"), "private").when(F.col("first").isNotNull(), F.concat(F.lit("public:"), F.col("first").cast("string"))).otherwise("uncertain-protected").alias("reason"))


def score_pairs(pairs: DataFrame, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Scores of (span_id, premise, hypothesis) rows; the scorer sees each distinct pair once and adds entail, neutral and contra."""
    scored = scorer(pairs.select("premise", "hypothesis").distinct())
    return pairs.join(scored, ["premise", "hypothesis"])
