"""Scores that need loops over words: diversity, overlap metrics, readability, stems, answers. Arrow batches, one function a row."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.text import ngram_hashes, words
from siltworks.registry import register
from siltworks.runtime import durable, require


def row_udf(f: Callable, kind: T.DataType, *columns: Column) -> Column:
    """f of the texts of each row, in Arrow batches; what isn't a text is None."""
    @F.pandas_udf(kind)
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([f(*[x if isinstance(x, str) else None for x in r]) for r in zip(*series)], dtype=object if kind == T.StringType() else None)

    return run(*columns)


# --- lexical diversity


def mtld(words: list[str], threshold: float = 0.72) -> float:
    def one(seq: list[str]) -> float:
        factors, seen, n = 0.0, set(), 0
        for w in seq:
            seen.add(w)
            n += 1
            if len(seen) / n <= threshold:
                factors, seen, n = factors + 1, set(), 0
        if n:
            factors += (1 - len(seen) / n) / (1 - threshold)
        return len(seq) / factors if factors else float(len(seq))

    return (one(words) + one(words[::-1])) / 2


def hdd(words: list[str], sample: int = 42) -> float:
    n = len(words)
    return sum(1 - math.exp(math.lgamma(n - k + 1) + math.lgamma(n - sample + 1) - math.lgamma(n + 1) - math.lgamma(n - k - sample + 1)) if n - k >= sample else 1.0 for k in Counter(words).values()) / sample


def _clean(t: str | None) -> list[str]:
    return re.sub(r"[^\w\s]", "", (t or "").lower()).split()


@register("lexical_diversity_sample_evaluator")
def lexical_diversity(df: DataFrame, input_key: str) -> DataFrame:
    """MTLD for more than 50 words, HD-D for 51 to 999; null otherwise."""
    require(df, input_key)

    @F.pandas_udf("mtld double, hdd double")
    def run(texts: pd.Series) -> pd.DataFrame:
        w = [_clean(t if isinstance(t, str) else None) for t in texts]
        return pd.DataFrame({"mtld": [mtld(x) if len(x) > 50 else None for x in w], "hdd": [hdd(x) if 50 < len(x) < 1000 else None for x in w]}, dtype=float)

    got = df.withColumn("_d", run(F.col(input_key)))
    return got.withColumns({"LexicalDiversityMTLDScore": F.col("_d.mtld"), "LexicalDiversityHD-DScore": F.col("_d.hdd")}).drop("_d")


@register("lexical_diversity_filter")
def lexical_diversity_filter(df: DataFrame, input_key: str, min_mtld: float = 50, min_hdd: float = 0.8) -> DataFrame:
    """Scores in range; missing scores pass."""
    d = lexical_diversity(df, input_key)
    a, b = F.col("LexicalDiversityMTLDScore"), F.col("`LexicalDiversityHD-DScore`")
    return d.filter((a.isNull() | (a >= min_mtld)) & (b.isNull() | b.between(min_hdd, 1.0)))


# --- overlap with a reference


def bleu1(candidate: str | None, reference: str | None) -> float:
    """Unigram precision with the brevity penalty."""
    c, r = (candidate or "").split(), (reference or "").split()
    if not c or not r:
        return 0.0
    hit = sum((Counter(c) & Counter(r)).values())
    p = (hit + 1e-15) / (len(c) + 1e-9)
    return p * (1.0 if len(c) >= len(r) else math.exp(1 - len(r) / len(c)))


@register("bleu_sample_evaluator")
def bleu(df: DataFrame, input_key: str, input_reference_key: str, output_key: str = "BleuScore") -> DataFrame:
    require(df, input_key, input_reference_key)
    return df.withColumn(output_key, row_udf(bleu1, T.DoubleType(), F.col(input_key), F.col(input_reference_key)))


@register("cider_sample_evaluator")
def cider(df: DataFrame, key: str, input_key: str, input_reference_key: str, n: int = 4, sigma: float = 6.0) -> DataFrame:
    """(key, CiderScore): tf-idf n-gram cosine with a length penalty; document frequencies are of all references.

    Both texts' n-grams, as 64-bit hashes, are counted side by side, so a gram is shuffled once for its counts and once for its frequency,
    where equal grams are added up before they are sent.
    """
    require(df, key, input_key, input_reference_key)
    hyp, ref = (words(F.lower(F.col(c))) for c in (input_key, input_reference_key))
    base = df.select(key, hyp.alias("_h"), ref.alias("_r"))
    side = lambda c, r: [F.transform(ngram_hashes(F.col(c), k), lambda g, k=k: F.struct(F.lit(k).alias("k"), g.alias("g"), F.lit(r).alias("r"), F.lit(1 - r).alias("h"))) for k in range(1, n + 1)]
    each = base.select(key, F.explode(F.concat(*side("_h", 0), *side("_r", 1))).alias("x")).select(key, "x.*")
    tf = each.groupBy(key, "k", "g").agg(F.sum("r").alias("r"), F.sum("h").alias("h"))
    total = F.lit(math.log(max(df.count(), 2)))
    part = tf.filter("r > 0").groupBy("k", "g").agg(F.count("*").alias("n"))
    w = tf.join(part, ["k", "g"], "left").withColumn("idf", total - F.log(F.coalesce("n", F.lit(1))))
    r, h = F.col("r") * F.col("idf"), F.col("h") * F.col("idf")
    per = w.groupBy(key, "k").agg(F.sum(F.least(r, h) * r).alias("dot"), F.sqrt(F.sum(r * r)).alias("nr"), F.sqrt(F.sum(h * h)).alias("nh"))
    mean = per.groupBy(key).agg((F.sum(F.coalesce(F.col("dot") / F.nullif(F.col("nr") * F.col("nh"), F.lit(0.0)), F.lit(0.0))) / n).alias("s"))
    d = (F.size("_h") - F.size("_r")).cast("double")
    return base.join(mean, key, "left").select(key, F.coalesce(F.col("s") * F.exp(-(d * d) / (2 * sigma**2)) * 10, F.lit(0.0)).alias("CiderScore"))


# --- readability

#: The metrics with their least and greatest accepted values.
READABILITY = {"flesch_reading_ease": (0.0, 100.0), "automated_readability_index": (0.0, 100.0), "aggregate_reading_level": (0.0, 100.0), "syllable_count": (32.0, 2331.9), "lexicon_count": (23.0, 1554.0), "sentence_count": (1.0, 89.1), "character_count": (118.0, 7466.3), "letter_count": (109.0, 7193.0), "polysyllable_count": (0.0, 216.4), "monosyllable_count": (13.0, 1044.1), "difficult_words": (4.0, 213.4)}


def readability(t: str | None) -> dict[str, float] | None:
    """The metrics of READABILITY; syllables are runs of vowels, a silent e apart, and a difficult word has three or more. None without a word."""
    w = re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", t or "")
    if not w:
        return None
    sentences = max(1, len(re.findall(r"[.!?。！？]+", t)))
    syllables = [max(1, len(re.findall(r"[aeiouyáàâäéèêëíîïóôöúùûü]+", x.lower()[:-1] if len(x) > 2 and x.lower().endswith("e") else x.lower()))) for x in w]
    n, letters, chars, syl = len(w), sum(map(len, w)), len(re.sub(r"\s", "", t)), sum(syllables)
    hard = sum(x >= 3 for x in syllables)
    ease = 206.835 - 1.015 * n / sentences - 84.6 * syl / n
    ari = 4.71 * letters / n + 0.5 * n / sentences - 21.43
    grades = sorted((0.39 * n / sentences + 11.8 * syl / n - 15.59, 0.4 * (n / sentences + 100 * hard / n), ari))
    return {"flesch_reading_ease": ease, "automated_readability_index": ari, "aggregate_reading_level": max(0.0, float(round(grades[1]))), "syllable_count": float(syl), "lexicon_count": float(n), "sentence_count": float(sentences), "character_count": float(chars), "letter_count": float(letters), "polysyllable_count": float(hard), "monosyllable_count": float(sum(x == 1 for x in syllables)), "difficult_words": float(len({x.lower() for x, k in zip(w, syllables) if k >= 3}))}


@register("langkit_sample_evaluator")
def readability_scores(df: DataFrame, input_key: str) -> DataFrame:
    """df with a Langkit...Score column for each metric; null for texts without a word."""
    require(df, input_key)
    names = tuple(READABILITY)

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(t: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([readability(x if isinstance(x, str) else None) or dict.fromkeys(names) for x in t], columns=list(names), dtype=float)

    got = df.withColumn("_r", run(F.col(input_key)))
    return got.withColumns({readability_column(n): F.col("_r")[n] for n in names}).drop("_r")


def readability_column(metric: str) -> str:
    return "Langkit" + "".join(x.capitalize() for x in metric.split("_")) + "Score"


@register("langkit_filter")
def readability_filter(df: DataFrame, input_key: str, metrics: tuple[str, ...] = tuple(READABILITY), ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """The rows whose metrics all lie in their ranges, ends included, with the scores and a label of each. Missing scores fail."""
    got = readability_scores(df, input_key)
    for m in metrics:
        lo, hi = {**READABILITY, **(ranges or {})}[m]
        c = readability_column(m)
        got = got.withColumn(f"{c}_label", F.coalesce(F.col(c).between(lo, hi), F.lit(False)).cast("int")).filter(F.col(f"{c}_label") == 1)
    return got


# --- answers


def extract_answer(t: str | None) -> str | None:
    """The last boxed answer, else what follows `answer is`, else the last number; without units and markup."""
    if not t:
        return None
    k = t.rfind("\\boxed{")
    if k >= 0:
        depth, i = 1, k + 7
        while i < len(t) and depth:
            depth += (t[i] == "{") - (t[i] == "}")
            i += 1
        got = t[k + 7 : i - 1]
    elif m := re.findall(r"(?i)answer\s*(?:is|:)\s*\$?([^\n.$]+)", t):
        got = m[-1]
    elif m := re.findall(r"-?\d[\d,]*(?:\.\d+)?(?:/\d+)?", t):
        got = m[-1]
    else:
        return None
    got = re.sub(r"\\(?:text|mathrm|mbox)\{([^}]*)\}", r"\1", got)
    return re.sub(r"\\[!,;: ]|\\left|\\right|[\s$%]|(?<=\d),(?=\d{3})", "", got).rstrip(".") or None


@register("answer_extraction")
def answers(df: DataFrame, input_key: str, output_key: str = "extracted_answer") -> DataFrame:
    return df.withColumn(output_key, row_udf(extract_answer, T.StringType(), F.col(input_key)))


def equal_answers(a: str | None, b: str | None) -> bool:
    """Whether two answers agree once extracted: as text, as numbers or as fractions."""
    x, y = extract_answer(a) or (a or "").strip(), extract_answer(b) or (b or "").strip()
    if not x or not y:
        return False
    if x == y:
        return True
    m, n = _value(x), _value(y)
    return m is not None and n is not None and abs(m - n) < 1e-9 * max(1.0, abs(m))


def _value(t: str) -> float | None:
    t = re.sub(r"\\[dt]?frac\{([^{}]+)\}\{([^{}]+)\}", r"\1/\2", t).replace(",", "")
    a, _, b = t.partition("/")
    try:
        return float(a) / float(b) if b else float(a)
    except (ValueError, ZeroDivisionError):
        return None


@register("bench_dataset_evaluator")
def match_answers(df: DataFrame, input_test_answer_key: str, input_gt_answer_key: str) -> DataFrame:
    """answer_match: whether the extracted answers agree, as text or as numbers."""
    return df.withColumn("answer_match", row_udf(equal_answers, T.BooleanType(), F.col(input_test_answer_key), F.col(input_gt_answer_key)))


@register("accuracy")
def accuracy(df: DataFrame, match: str = "answer_match") -> DataFrame:
    m = F.col(match)
    return df.agg(F.count("*").alias("total"), F.count(m).alias("valid"), F.sum(m.cast("int")).alias("matched"), F.avg(m.cast("int")).alias("accuracy"))


# --- stems and spelling


def _measure(s: str) -> int:
    """Number of vowel-consonant sequences of a stem."""
    return len(re.findall(r"v+c+", "".join("v" if _vowel(s, i) else "c" for i in range(len(s)))))


def _vowel(s: str, i: int) -> bool:
    return s[i] in "aeiou" or (s[i] == "y" and i > 0 and not _vowel(s, i - 1))


def _cvc(s: str) -> bool:
    return len(s) > 2 and not _vowel(s, len(s) - 3) and _vowel(s, len(s) - 2) and not _vowel(s, len(s) - 1) and s[-1] not in "wxy"


#: Suffixes of the published algorithm's steps 2 to 4.
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def stem(w: str) -> str:
    """Porter's stemmer (1980), all five steps."""
    if len(w) <= 2:
        return w
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    has_vowel = lambda s: any(_vowel(s, i) for i in range(len(s)))
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif (w.endswith("ed") and has_vowel(w[:-2])) or (w.endswith("ing") and has_vowel(w[:-3])):
        w = w[:-2] if w.endswith("ed") else w[:-3]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for pairs in (_STEP2, _STEP3):
        for a, b in sorted(pairs, key=lambda x: -len(x[0])):
            if w.endswith(a):
                w = w[: len(w) - len(a)] + b if _measure(w[: len(w) - len(a)]) > 0 else w
                break
    for a in sorted(_STEP4, key=lambda x: -len(x)):
        if w.endswith(a):
            base = w[: len(w) - len(a)]
            if _measure(base) > 1 and (a != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


@register("stemming_lemmatization_refiner")
def stemming(df: DataFrame, input_key: str, method: str = "stemming", lemma: Callable[[str], str] | None = None) -> DataFrame:
    """Each word, in lower case, by its stem; or by `lemma`, a function of a word that runs on executors (method lemmatization)."""
    if method == "lemmatization" and lemma is None:
        raise ValueError("lemmatization needs a function that knows lemmas")
    one = (lambda x: stem(x.lower())) if method == "stemming" else lemma
    f = lambda t: None if t is None else " ".join(one(x) for x in t.split())
    return df.withColumn(input_key, row_udf(f, T.StringType(), F.col(input_key)))


class Speller:
    """Corrections from a frequency list by deletions (symmetric): a word goes to the nearest known one within `most` edits, of equals the most frequent."""

    def __init__(self, frequency: dict[str, int], most: int = 2, prefix: int = 7):
        self.frequency, self.most, self.prefix = frequency, most, prefix
        self.by: dict[str, list[str]] = {}
        for w in frequency:
            for d in self._deletions(w[:prefix]):
                self.by.setdefault(d, []).append(w)

    def _deletions(self, w: str) -> set[str]:
        out, last = {w}, {w}
        for _ in range(self.most):
            last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
            out |= last
        return out

    @staticmethod
    def distance(a: str, b: str) -> int:
        """Edits with neighbours swapped (optimal string alignment)."""
        rows = [list(range(len(b) + 1))]
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y)))
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                    row[-1] = min(row[-1], rows[-2][j - 2] + 1)
            rows.append(row)
        return rows[-1][-1]

    def __call__(self, word: str) -> str:
        if word in self.frequency or not word.isalpha():
            return word
        found = {w for d in self._deletions(word[: self.prefix]) for w in self.by.get(d, ()) if abs(len(w) - len(word)) <= self.most}
        near = [(k, -self.frequency[w], w) for w in found if (k := self.distance(word, w)) <= self.most]
        return min(near)[2] if near else word


@register("spelling_correction_refiner")
def spelling(df: DataFrame, input_key: str, frequency: dict[str, int], most: int = 2) -> DataFrame:
    """Each word by its nearest known one; frequency: word -> count, of a bounded list. Words in capitals or with digits stay."""
    require(df, input_key)
    speller = Speller(frequency, most)
    f = lambda t: None if t is None else re.sub(r"(?<![\w])[^\W\d_]+(?![\w])", lambda m: m[0] if m[0].isupper() else speller(m[0].lower()) if not m[0][0].isupper() else speller(m[0].lower()).capitalize(), t)
    return df.withColumn(input_key, row_udf(f, T.StringType(), F.col(input_key)))


# --- dataset scores over vectors

#: Rounds of k_center after which its distances are written.
ROUNDS = 8


@register("vendi_dataset_evaluator")
def vendi(df: DataFrame, vector: str) -> DataFrame:
    """One row: the exponential of the entropy of the cosine kernel's eigenvalues, by the (dim x dim) second moments, which are summed on executors."""
    def run(batches):
        for b in batches:
            x = np.stack([np.asarray(v, float) for v in b["v"]]) if len(b) else None
            if x is not None:
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({"n": [len(x)], "m": [(x.T @ x).ravel()]})

    part = df.select(F.col(vector).alias("v")).filter("v IS NOT NULL").mapInPandas(run, "n bigint, m array<double>")
    summed = part.select("n", F.posexplode("m").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("i").collect()
    if not summed:
        return df.sparkSession.createDataFrame([(0, None)], "n bigint, vendi double")
    d = math.isqrt(len(summed))
    ev = np.linalg.eigvalsh(np.array([r["x"] for r in summed]).reshape(d, d) / summed[0]["n"])
    ev = ev[ev > 1e-12]
    return df.sparkSession.createDataFrame([(summed[0]["n"], float(np.exp(-(ev * np.log(ev)).sum())))], "n bigint, vendi double")


def _nearer(centre: np.ndarray) -> Callable:
    @F.pandas_udf("double")
    def run(v: pd.Series, d: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()) - centre
        return pd.Series(np.minimum(d.to_numpy(), np.sqrt((x * x).sum(1))))

    return run


@register("kcenter_greedy_filter")
def k_center(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """k rows, each the farthest from those before it; the first has the least key. Keys are unique.

    A round reads each vector once, with its distance to the nearest centre so far, and the new centre only is sent to executors. Centres
    are found one after another by their nature, so k rounds are k passes; the distances are written every ROUNDS rounds.
    """
    require(df, key, vector)
    base = durable(df.filter(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v"), F.lit(float("inf")).alias("d")))
    chosen: list = []
    new = base.orderBy(key).limit(1).select(key, "v").collect()
    while new and len(chosen) < k:
        centre = np.array(new[0]["v"])
        chosen.append(new[0][key])
        base = base.withColumn("d", _nearer(centre)("v", "d"))
        if len(chosen) % ROUNDS == 0:
            base = durable(base)
        best = base.agg(F.max_by(F.struct(key, "v"), F.struct("d", key)).alias("r"), F.max("d").alias("d")).first()
        new = [best["r"]] if best["r"] is not None and best["d"] > 0 else []
    return df.join(df.sparkSession.createDataFrame([(c,) for c in chosen], f"{key} {df.schema[key].dataType.simpleString()}"), key, "left_semi")
