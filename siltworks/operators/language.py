"""Language models of character n-grams, trained here: the language of a text, and the perplexity of a text.

Training reads a bounded sample of rows (`bound` rows a language, those of least hash); everything else covers all rows.
"""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siltworks.registry import register
from siltworks.runtime import require

SLOTS = 1 << 18


def _codes(text: str) -> np.ndarray:
    return np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)


def _slots(code: np.ndarray, n: int) -> np.ndarray:
    """A slot for each n-gram of codes."""
    out = np.zeros(max(0, len(code) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ code[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
    return (out % np.uint64(SLOTS)).astype(np.int64)


def sample(df: DataFrame, label: str, text: str, bound: int) -> list[tuple[str, str]]:
    """At most `bound` rows a label: the least hashes of their texts, first within salted parts, so that no label is gathered in one task."""
    base = df.filter(F.col(label).isNotNull() & (F.length(F.trim(text)) > 20)).select(F.col(label).alias("l"), F.col(text).alias("t")).withColumn("h", F.xxhash64("t"))
    part = base.withColumn("p", F.pmod("h", F.lit(32))).withColumn("k", F.row_number().over(W.partitionBy("l", "p").orderBy("h", "t"))).filter(F.col("k") <= bound)
    few = part.withColumn("k", F.row_number().over(W.partitionBy("l").orderBy("h", "t"))).filter(F.col("k") <= bound)
    return sorted((r["l"], r["t"]) for r in few.select("l", "t").collect())


class LanguageModel:
    """Naive Bayes over hashed character n-grams of length 1 to 3."""

    def __init__(self, labels: list[str], weights: np.ndarray):
        self.labels, self.weights = labels, weights

    @classmethod
    def fit(cls, rows: list[tuple[str, str]]) -> LanguageModel:
        labels = sorted({label for label, _ in rows})
        counts = np.zeros((SLOTS, max(1, len(labels))), np.float32)
        for label, text in rows:
            c = _codes(text)
            for n in (1, 2, 3):
                np.add.at(counts[:, labels.index(label)], _slots(c, n), 1)
        # a gram that no label has says nothing
        p = (counts + 0.05) / (counts.sum(0) + 0.05 * SLOTS)
        return cls(labels, np.where(counts.sum(1, keepdims=True) > 0, np.log(p), 0).astype(np.float32))

    def rank(self, text: str | None, most: int = 5) -> list[str]:
        """The labels from likeliest on; none for a text without letters."""
        if not text or not any(c.isalpha() for c in text) or not self.labels:
            return []
        c = _codes(text)
        s = sum(self.weights[_slots(c, n)].sum(0) for n in (1, 2, 3))
        return [self.labels[i] for i in np.argsort(-s, kind="stable")[:most]]


def languages(text: Column, model: LanguageModel, most: int = 5) -> Column:
    """The likeliest languages of a text."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([model.rank(t if isinstance(t, str) else None, most) for t in texts], dtype=object)

    return run(text)


@register("language_filter")
def language_filter(df: DataFrame, input_key: str, allowed: list[str], model: LanguageModel, output_key: str = "language_label", most: int = 5) -> DataFrame:
    """The rows of which one of the `most` likeliest languages is allowed; the output column holds these languages."""
    require(df, input_key)
    return df.withColumn(output_key, languages(F.col(input_key), model, most)).filter(F.arrays_overlap(output_key, F.array(*map(F.lit, allowed))))


class CharacterModel:
    """A character model of orders 0 to 3, each order interpolated with the one below by the number of different followers (Witten-Bell)."""

    ORDER = 3

    def __init__(self, total: list[np.ndarray], kinds: list[np.ndarray], pairs: list[np.ndarray]):
        self.total, self.kinds, self.pairs = total, kinds, pairs

    @classmethod
    def fit(cls, texts: list[str]) -> CharacterModel:
        total = [np.zeros(SLOTS, np.float32) for _ in range(cls.ORDER + 1)]
        pairs = [np.zeros(SLOTS, np.float32) for _ in range(cls.ORDER + 1)]
        kinds = [np.zeros(SLOTS, np.float32) for _ in range(cls.ORDER + 1)]
        seen: list[set] = [set() for _ in range(cls.ORDER + 1)]
        for t in texts:
            c = _codes(t)
            for n in range(cls.ORDER + 1):
                gram = _slots(c, n + 1)
                context = _slots(c, n)[: len(gram)] if n else np.zeros(len(gram), np.int64)
                np.add.at(total[n], context, 1)
                np.add.at(pairs[n], gram, 1)
                for a, b in set(zip(context.tolist(), gram.tolist())) - seen[n]:
                    seen[n].add((a, b))
                    kinds[n][a] += 1
        return cls(total, kinds, pairs)

    def bits(self, text: str, before: str = "") -> float:
        """Mean nats a character of text, as it follows `before`."""
        c, skip = _codes(before + " " + text if before else text), len(_codes(before)) - 1 if before else 0
        p = np.full(len(c), 1 / 5000)
        for n in range(self.ORDER + 1):
            gram = _slots(c, n + 1)
            context = _slots(c, n)[: len(gram)] if n else np.zeros(len(gram), np.int64)
            t, k, f = self.total[n][context], self.kinds[n][context], self.pairs[n][gram]
            low = p[n:]
            p = np.concatenate([p[:n], np.where(t > 0, (f + k * low) / np.maximum(t + k, 1), low)])
        own = p[skip:]
        return float(-np.log(np.maximum(own, 1e-12)).mean()) if len(own) else math.nan

    def perplexity(self, text: str | None, before: str | None = "") -> float | None:
        return math.exp(self.bits(text, before or "")) if text and text.strip() else None


def perplexities(model: CharacterModel):
    """The scorer of `perplexity`: how surprising each text is to the model; null for blank texts."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([model.perplexity(t if isinstance(t, str) else None) for t in texts], dtype=float)

    return run


def difficulties(model: CharacterModel):
    """The scorer of `superfiltering`: the output's perplexity after its instruction, by its own; null without an output."""

    @F.pandas_udf("double")
    def run(instructions: pd.Series, outputs: pd.Series) -> pd.Series:
        out = []
        for i, o in zip(instructions, outputs):
            alone = model.perplexity(o if isinstance(o, str) else None)
            out.append(None if alone is None else model.perplexity(o, i if isinstance(i, str) else "") / alone)
        return pd.Series(out, dtype=float)

    return run
