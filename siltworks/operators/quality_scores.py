"""Scores of a model over the columns of a row, and the filters on their ranges.

A scorer takes the input Columns and gives a Column: a number, a label or a struct of numbers. `model_scorer` wraps a Python model that
is loaded once a worker and called with Arrow batches; any native expression serves as well. SCORES names each score's
columns and its range; `range_filter` holds for all of them. A range includes both its ends. A missing score (null or NaN)
fails, save where the score says that it passes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.registry import register
from siltworks.runtime import require

Scorer = Callable[..., Column]


def model_scorer(load: Callable[[], Callable[..., list]], kind: str = "double") -> Scorer:
    """A scorer from a function that loads a model; the model takes one list a column and gives one list of results."""

    def score(*columns: Column) -> Column:
        held: list = []

        @F.pandas_udf(kind)
        def run(*series: pd.Series) -> pd.Series:
            if not held:
                held.append(load())
            out = held[0](*[[x if isinstance(x, str) else None for x in s] for s in series])
            return pd.Series(out, dtype=float if kind == "double" else object)

        return run(*columns)

    return score


@dataclass(frozen=True)
class Score:
    """columns: default names of the inputs. parts: names of a struct's fields with their own ranges. passes: whether a missing score does."""

    columns: tuple[str, ...]
    output: str
    low: float = 0.0
    high: float = 0.0
    labels: tuple[str, ...] = ()
    parts: tuple[tuple[str, float, float], ...] = ()
    passes: bool = False


_PAIR = ("instruction", "output")
#: The scores' names, columns and ranges.
SCORES = {
    "debertav3": Score(("raw_content",), "Debertav3Score", labels=("Medium", "High")),
    "fineweb_edu": Score(("raw_content",), "FinewebEduScore", 2.5, 10_000),
    "pair_qual": Score(("raw_content",), "PairQualScore", 0, 10_000),
    "perplexity": Score(("raw_content",), "PerplexityScore", 10, 500),
    "qurating": Score(("raw_content",), "QuratingScore", parts=(("writing_style", 0, 9), ("required_expertise", 0, 9), ("facts_and_trivia", 0, 9), ("educational_value", 0, 9))),
    "textbook": Score(("raw_content",), "TextbookScore", 0.99, 1),
    "deita_complexity": Score(_PAIR, "DeitaComplexityScore", 3, 5),
    "deita_quality": Score(_PAIR, "DeitaQualityScore", 2.5, 10_000),
    "instag": Score(("instruction",), "InstagScore", 0, 1),
    "rm": Score(_PAIR, "RMScore", 0.2, 0.8),
    "superfiltering": Score(_PAIR, "SuperfilteringScore", 0, 1),
    "perspective": Score(("raw_content",), "PerspectiveScore", 0, 0.5, passes=True),
    "presidio": Score(("raw_content",), "PresidioScore", 0, 5),
    "bert": Score(("input", "reference"), "BertScore", 0, 1),
}


def evaluate(df: DataFrame, score: str, scorer: Scorer, inputs: tuple[str, ...] | None = None, output: str | None = None) -> DataFrame:
    """df with the score's column, or one column for each of its parts."""
    s = SCORES[score]
    names = inputs or s.columns
    require(df, *names)
    out = output or s.output
    got = df.withColumn(out, scorer(*map(F.col, names)))
    if not s.parts:
        return got
    return got.withColumns({p: F.col(out)[p].cast("double") for p, _, _ in s.parts}).drop(out)


def within(c: Column, low: float, high: float, passes: bool = False) -> Column:
    """Whether a number lies in a range, ends included. NaN counts as missing."""
    missing = c.isNull() | F.isnan(c.cast("double"))
    return F.when(missing, F.lit(passes)).otherwise(c.between(low, high))


def range_filter(df: DataFrame, score: str, scorer: Scorer, inputs: tuple[str, ...] | None = None, output: str | None = None, low: float | None = None, high: float | None = None, labels: tuple[str, ...] | None = None) -> DataFrame:
    """The rows whose score is in its range (or whose label is one of those allowed), with the score's columns; parts also get `{part}_label`."""
    s = SCORES[score]
    got = evaluate(df, score, scorer, inputs, output)
    if s.parts:
        ok = {f"{p}_label": within(F.col(p), a if low is None else low, b if high is None else high).cast("int") for p, a, b in s.parts}
        got = got.withColumns(ok)
        for name in ok:
            got = got.filter(F.col(name) == 1)
        return got
    c = F.col(output or s.output)
    if s.labels:
        return got.filter(F.coalesce(c.isin(*(labels or s.labels)), F.lit(False)))
    return got.filter(within(c, s.low if low is None else low, s.high if high is None else high, s.passes))


for _name in SCORES:
    register(f"{_name}_sample_evaluator")(partial(lambda df, scorer, score, **kw: evaluate(df, score, scorer, **kw), score=_name))
    register(f"{_name}_filter")(partial(lambda df, scorer, score, **kw: range_filter(df, score, scorer, **kw), score=_name))


# --- heads that turn a model's outputs into scores


def expected_level(probabilities: Column, levels: tuple[float, ...]) -> Column:
    """The mean of the levels by their probabilities, as for Low, Mid, High = 1, 3, 5."""
    return F.aggregate(F.zip_with(probabilities, F.array(*map(F.lit, map(float, levels))), lambda p, v: p * v), F.lit(0.0), lambda a, x: a + x)


def softmax_level(logits: Column, levels: tuple[float, ...] = (1, 2, 3, 4, 5, 6)) -> Column:
    """The mean of the levels by the softmax of their logits."""
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return expected_level(F.transform(e, lambda x: x / total), levels)


def tag_count(response: Column) -> Column:
    """Number of tags in a JSON list; 1 for a JSON object, else 0."""
    t = F.trim(F.coalesce(response, F.lit("")))
    n = F.size(F.from_json(t, "array<struct<tag:string>>"))
    return F.when(t.startswith("["), F.greatest(F.coalesce(n, F.lit(0)), F.lit(0))).when(F.try_parse_json(t).isNotNull() & t.startswith("{"), F.lit(1)).otherwise(F.lit(0))


def instruction_following_difficulty(conditional: Column, alone: Column) -> Column:
    """Perplexity of the output after its instruction, by that of the output alone; 0 where that is 0."""
    return F.when(alone == 0, F.lit(0.0)).otherwise(conditional / alone)


def truncated_bytes(c: Column, most: int = 20_480) -> Column:
    """The text's first bytes, without a character that is cut."""
    return F.when(F.octet_length(c) <= most, c).otherwise(F.regexp_replace(F.decode(F.substring(F.encode(c, "UTF-8"), 1, most), "UTF-8"), "�+$", ""))


def pii_count(c: Column) -> Column:
    """Number of mail and network addresses, card, social security and phone numbers in a text; the scorer of `presidio` without a model."""
    from siltworks.operators.refiners import PII

    left, total = F.coalesce(c, F.lit("")), F.lit(0)
    for pattern, _ in PII:
        total = total + F.regexp_count(left, F.lit(pattern))
        left = F.regexp_replace(left, pattern, " ")
    return total.cast("double")


@register("task2vec_dataset_evaluator")
def diversity(df: DataFrame, vector: str, samples: int = 10, size: int = 100, seed: int = 7) -> DataFrame:
    """One row (mean, low, high): mean cosine distance within `samples` random sets of `size` vectors, with its 95 % interval.

    A row is in a set by the hash of its vector and the set's number; each set's least `size` hashes count, so all that is
    gathered is samples x size vectors, whatever df's size.
    """
    import numpy as np

    from pyspark.sql.window import Window as W

    require(df, vector)
    each = df.filter(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v")).withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn("h", F.xxhash64("v", "s", F.lit(seed)))
    salted = each.withColumn("p", F.pmod("h", F.lit(64))).withColumn("k", F.row_number().over(W.partitionBy("s", "p").orderBy("h"))).filter(F.col("k") <= size)
    rows = salted.withColumn("k", F.row_number().over(W.partitionBy("s").orderBy("h"))).filter(F.col("k") <= size).select("s", "v").collect()
    got = []
    for s in range(1, samples + 1):
        x = np.array([r["v"] for r in rows if r["s"] == s])
        if len(x) > 1:
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            got.append(1 - ((x @ x.T).sum() - len(x)) / (len(x) * (len(x) - 1)))
    m = float(np.mean(got)) if got else None
    half = 1.96 * float(np.std(got)) / len(got) ** 0.5 if got else 0.0
    return df.sparkSession.createDataFrame([(m, m - half if got else None, m + half if got else None)], "mean double, low double, high double")
