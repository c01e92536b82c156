"""Scores of answers against references: benchmark evaluation in six forms, ground-truth filters, compounds, categories."""

from __future__ import annotations

import re
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.text import nz
from siltworks.operators.scores import equal_answers, extract_answer, row_udf
from siltworks.operators.serving import Reply, ask, template
from siltworks.registry import register
from siltworks.runtime import require

#: The six forms of a benchmark's rows and the metric of each.
FORMS = {"key1_text_score": "ppl", "key2_qa": "math_verify", "key2_q_ma": "any_math_verify", "key3_q_choices_a": "ll_choice_acc", "key3_q_choices_as": "micro_f1", "key3_q_a_rejected": "pairwise_ll_winrate"}


def _equal(a: Column, b: Column) -> Column:
    return row_udf(equal_answers, T.BooleanType(), a, b)


def _extracted(a: Column) -> Column:
    return row_udf(extract_answer, T.StringType(), a)


def choice_of(text: Column, choices: Column) -> Column:
    """Index of the choice that a text names: its first lone letter, else its first lone number, from 0 or else from 1; null without any."""
    n = F.size(choices)
    t = F.trim(nz(text))
    letter = F.upper(F.regexp_extract(t, r"(?<!\w)([A-Za-z])(?!\w)", 1))
    by_letter = F.when(letter != "", F.ascii(letter) - 65)
    k = F.nullif(F.regexp_extract(t, r"(?<!\w)(\d+)(?!\w)", 1), F.lit("")).try_cast("int")
    return F.when(by_letter.between(0, n - 1), by_letter).when(k.between(0, n - 1), k).when(k == n, k - 1)


def choices_of(text: Column, choices: Column) -> Column:
    """Indexes of the choices that a text names, by letters and numbers, in order and each once; parts are divided by commas, semicolons or spaces."""
    parts = F.filter(F.split(F.regexp_replace(nz(text), r"[\[\](){}'\"]", " "), r"[,;\s]+"), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, lambda x: F.when(x.rlike(r"^[A-Za-z]$|^\d+$"), choice_of(x, choices))), lambda i: i.isNotNull())))


def set_f1(a: Column, b: Column) -> Column:
    """F1 of two sets given as arrays; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * both / total)


@register("unified_bench_dataset_evaluator")
def unified_bench(df: DataFrame, form: str, pred: str = "generated_ans", target: str | None = None, targets: str | None = None, choices: str | None = None, label: str | None = None, labels: str | None = None, better: str | None = None, rejected: str | None = None, text: str | None = None, scorer: Callable[..., Column] | None = None) -> DataFrame:
    """df with eval_valid, eval_error, eval_pred and eval_score by the form's metric.

    key1_text_score: the scorer's perplexity of the text. key2_qa: the extracted answer equals the target's. key2_q_ma: it equals any of
    targets. key3_q_choices_a: the named choice is the label. key3_q_choices_as: F1 of the named choices and labels.
    key3_q_a_rejected: the scorer prefers (has the lower perplexity for) the better answer.
    A row without what its form needs isn't valid, says why and has no score.
    """
    if form not in FORMS:
        raise ValueError(f"form is one of {', '.join(FORMS)}")
    p = F.col(pred) if pred in df.columns else F.lit(None).cast("string")
    none = F.lit(None).cast("string")
    if form == "key1_text_score":
        require(df, text)
        if scorer is None:
            return df.withColumns({"eval_valid": F.lit(False), "eval_error": F.lit("ppl_unavailable"), "eval_pred": none, "eval_score": F.lit(None).cast("double")})
        ok, why, said, score = F.col(text).isNotNull(), "no text", none, scorer(F.col(text))
    elif form == "key2_qa":
        require(df, pred, target)
        ok, why, said, score = p.isNotNull() & F.col(target).isNotNull(), "no answer or target", _extracted(p), _equal(p, F.col(target)).cast("double")
    elif form == "key2_q_ma":
        require(df, pred, targets)
        rows = df.withColumn("_row", F.monotonically_increasing_id())
        hit = rows.select("_row", p.alias("_p"), F.explode(targets).alias("_t")).groupBy("_row").agg(F.max(_equal(F.col("_p"), F.col("_t")).cast("double")).alias("_hit"))
        df = rows.join(hit, "_row", "left").drop("_row")
        ok, why, said, score = p.isNotNull() & (F.size(targets) > 0), "no answer or targets", _extracted(p), F.col("_hit")
    elif form == "key3_q_choices_a":
        require(df, pred, choices, label)
        i = choice_of(p, F.col(choices))
        ok, why, said, score = i.isNotNull() & F.col(label).isNotNull(), "no choice named", i.cast("string"), (i == F.col(label)).cast("double")
    elif form == "key3_q_choices_as":
        require(df, pred, choices, labels)
        i = choices_of(p, F.col(choices))
        ok, why, said, score = (F.size(i) > 0) & F.col(labels).isNotNull(), "no choice named", F.array_join(i, ","), set_f1(i, F.transform(labels, lambda x: x.cast("int")))
    else:
        require(df, better, rejected)
        if scorer is None:
            return df.withColumns({"eval_valid": F.lit(False), "eval_error": F.lit("ll_unavailable"), "eval_pred": none, "eval_score": F.lit(None).cast("double")})
        a, b = scorer(F.col(better)), scorer(F.col(rejected))
        ok, why, said, score = a.isNotNull() & b.isNotNull(), "no answers", none, (a < b).cast("double")
    ok = F.coalesce(ok, F.lit(False))
    return df.withColumns({"eval_valid": ok, "eval_error": F.when(ok, "").otherwise(why), "eval_pred": F.when(ok, said), "eval_score": F.when(ok, score)}).drop("_hit")


def bench_summary(df: DataFrame) -> DataFrame:
    """total, valid and mean score of an evaluated benchmark."""
    return df.agg(F.count("*").alias("total"), F.sum(F.col("eval_valid").cast("int")).alias("valid"), F.avg("eval_score").alias("score"))


@register("bench_answer_generator")
def bench_answers(df: DataFrame, form: str, reply: Reply, output: str = "generated_ans", question: str = "question", choices: str | None = None, context: str | None = None, force: bool = False) -> DataFrame:
    """df with the model's answers; only for the forms that need one (key2 and several choices), unless forced; else null."""
    if form not in FORMS:
        raise ValueError(f"form is one of {', '.join(FORMS)}")
    if not force and form not in ("key2_qa", "key2_q_ma", "key3_q_choices_as"):
        return df.withColumn(output, F.lit(None).cast("string"))
    require(df, question)
    listed = F.array_join(F.transform(choices, lambda x, i: F.concat(F.chr(i + 65), F.lit(". "), x)), "\n") if choices else F.lit("")
    head = F.col(context) if context else F.lit("")
    return ask(df, template("{c}\n{q}\n{o}", c=head, q=F.col(question), o=listed), output, reply)


@register("bench_dataset_evaluator_question")
def bench_with_questions(df: DataFrame, answer: str, truth: str, question: str | None = None, reply: Reply | None = None, subquestions: bool = False) -> DataFrame:
    """df with answer_match_result: by extraction, or the model's judgement. subquestions: the share of the truth's parts (JSON list) that the model says are answered, as correct_ratio."""
    require(df, answer, truth, *([question] if question else []))
    if reply is None:
        return df.withColumn("answer_match_result", _equal(F.col(answer), F.col(truth)))
    got = ask(df, template("Judge each part of the answer: true or false.\nQ: {q}\nA: {a}\nR: {r}", q=F.col(question) if question else F.lit(""), a=F.col(answer), r=F.col(truth)), "_response", reply)
    hits, all_ = (F.regexp_count(F.lower(F.coalesce("_response", F.lit(""))), F.lit(p)) for p in (r"\btrue\b", r"\b(?:true|false)\b"))
    if subquestions:
        return got.withColumns({"correct_ratio": F.when(all_ > 0, hits / all_).otherwise(0.0), "answer_match_result": (all_ > 0) & (hits == all_)}).drop("_response")
    return got.withColumn("answer_match_result", (hits > 0) & (hits == all_)).drop("_response")


@register("reasoning_answer_groundtruth_filter")
def groundtruth_filter(df: DataFrame, answer: str = "generated_cot", truth: str = "golden_answer", method: str = "math_verify") -> DataFrame:
    """The rows whose extracted answer is the truth: as a string (exact) or also as a number (math_verify)."""
    require(df, answer, truth)
    if method not in ("exact", "math_verify"):
        raise ValueError("method is exact or math_verify")
    same = _extracted(F.col(answer)) == F.trim(truth) if method == "exact" else _equal(F.col(answer), F.col(truth))
    return df.filter(F.col(truth).isNotNull() & F.coalesce(same, F.lit(False)))


@register("reasoning_answer_pipeline_root_filter")
def pipeline_root(df: DataFrame, answer: str = "output", truth: str = "golden_answer") -> DataFrame:
    """df with missing truths filled from the answers, and has_gt: both parts in one frame, to be filtered on it."""
    require(df, answer, truth)
    filled = F.coalesce(F.nullif(F.trim(truth), F.lit("")), _extracted(F.col(answer)))
    return df.withColumn(truth, filled).withColumn("has_gt", F.col(truth).isNotNull())


@register("reasoning_answer_formatter_filter")
def formatter_filter(df: DataFrame, input_key: str = "generated_cot") -> DataFrame:
    """All rows: every answer counts as well formed."""
    require(df, input_key)
    return df


# --- compounds


@register("smiles_equivalence_dataset_evaluator")
def smiles_equivalence(df: DataFrame, golden: str = "golden_label", synth: str = "synth_smiles", output: str = "final_result", canonical: Callable[[Column], Column] = lambda c: F.regexp_replace(c, r"\s", "")) -> DataFrame:
    """df with a score for each golden compound, block_score, block_total and block_accuracy (null for no compounds).

    golden, synth: arrays of structs with abbreviation and smiles. A compound is found by its abbreviation (the last one given)
    and counts if both notations are equal in canonical form; `canonical` may be a chemistry library's.
    """
    require(df, golden, synth)
    some = F.filter(F.coalesce(F.col(synth), F.array().cast(df.schema[synth].dataType)), lambda x: x["abbreviation"].isNotNull() & x["smiles"].isNotNull())

    def score(g: Column) -> Column:
        last = F.try_element_at(F.filter(F.col("_s"), lambda x: x["abbreviation"] == F.coalesce(g["abbreviation"], F.lit(""))), F.lit(-1))
        same = canonical(last["smiles"]) == canonical(F.coalesce(g["smiles"], F.lit("")))
        return F.struct(F.coalesce(g["abbreviation"], F.lit("")).alias("abbreviation"), F.coalesce(g["smiles"], F.lit("")).alias("smiles"), F.coalesce(same, F.lit(False)).cast("int").alias("score"))

    got = df.withColumn("_s", F.when(F.size(some) > 0, some).otherwise(F.array(F.lit(None).cast(df.schema[synth].dataType.elementType)))).withColumn(output, F.transform(F.coalesce(F.col(golden), F.array().cast(df.schema[golden].dataType)), score)).drop("_s")
    n = F.size(output)
    return got.withColumns({"block_score": F.aggregate(F.col(output)["score"], F.lit(0), lambda a, x: a + x), "block_total": n}).withColumn("block_accuracy", F.when(n > 0, F.col("block_score") / n))


def smiles_summary(df: DataFrame) -> DataFrame:
    s, t = F.sum("block_score"), F.sum("block_total")
    return df.agg(s.alias("overall_score"), t.alias("overall_total"), F.when(t > 0, s / t).alias("overall_accuracy"))


# --- categories

#: The categories of mathematical problems.
TAXONOMY = {
    "Foundations and Logic": ("Mathematical Logic and Set Theory", "Basic Theory, Formalization, and History & Education"),
    "Algebra and Number Theory": ("Linear Algebra and Group Theory", "Ring Theory, Field Theory, and Polynomial Algebra", "Commutative Algebra and Homological/Categorical Methods", "Number Theory", "Algebraic Geometry"),
    "Analysis and Differential Equations": ("Real Analysis, Measure Theory, and Functional Analysis", "Complex Analysis and Special Functions", "Differential Equations and Dynamical Systems", "Integral Transforms, Integral Equations, and Difference Equations", "Harmonic Analysis"),
    "Geometry and Topology": ("Euclidean, Analytic, and Convex/Discrete Geometry", "Differential Geometry and Manifold Theory", "Topology and Algebraic Topology"),
    "Probability, Statistics, and Discrete Mathematics": ("Probability Theory and Stochastic Processes", "Mathematical Statistics", "Combinatorics and Graph Theory"),
    "Applied and Computational Mathematics": ("Numerical Analysis and Computational Methods", "Optimal Control, Variational Methods, and Optimization", "Operations Research and Game Theory", "Systems Theory and Control", "Computer Science and Algorithms", "Mathematical Physics and Engineering Mathematics", "Information and Communication", "Bimathematics"),
    "Arithmetic": ("Basic Arithmetic and Number Operations", "Word Problems and Real-Life Applications"),
}


def nearest_label(raw: str | None, choices: tuple[str, ...], least: float = 0.5) -> str:
    """The choice most like a label, by words in any order and by characters; empty under `least`."""
    def plain(x: str) -> str:
        return " ".join(re.sub(r"[\d.\-_()\[\],&/]", " ", x.lower()).split())

    a = plain(raw or "")
    best, top = "", 0.0
    for c in choices if a else ():
        b = plain(c)
        x, y = set(a.split()), set(b.split())
        like = max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, " ".join(sorted(x)), " ".join(sorted(y))).ratio(), 0.9 * len(x & y) / max(1, min(len(x), len(y))))
        if like > top:
            best, top = c, like
    return best if top >= least else ""


def category(primary: str | None, secondary: str | None, taxonomy: dict[str, tuple[str, ...]] = TAXONOMY) -> tuple[str, str]:
    """(primary, secondary) of raw labels: by number (`2.1`, or `2`), else by likeness; empty where nothing fits."""
    names = tuple(taxonomy)
    if m := re.fullmatch(r"\s*(\d+)\s*\.\s*(\d+)\s*\.?\s*", secondary or ""):
        p, s = int(m[1]), int(m[2])
        if 1 <= p <= len(names) and 1 <= s <= len(taxonomy[names[p - 1]]):
            return names[p - 1], taxonomy[names[p - 1]][s - 1]
    m = re.fullmatch(r"\s*(\d+)\s*\.?\s*", primary or "")
    first = names[int(m[1]) - 1] if m and 1 <= int(m[1]) <= len(names) else nearest_label(primary, names)
    return (first, nearest_label(secondary, taxonomy[first])) if first else ("", "")


def _category(a: Column, b: Column) -> Column:
    @F.pandas_udf("primary_category string, secondary_category string")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([category(p if isinstance(p, str) else None, q if isinstance(q, str) else None) for p, q in zip(x, y)], columns=["primary_category", "secondary_category"])

    return run(a, b)


@register("reasoning_question_category_sample_evaluator")
def question_category(df: DataFrame, reply: Reply, input_key: str = "instruction") -> DataFrame:
    """df with primary_category and secondary_category: the labels of the model's JSON, brought to the taxonomy's names."""
    require(df, input_key)
    got = ask(df, template("Name the category as JSON with primary_category and secondary_category.\n{q}", q=F.col(input_key)), "_response", reply)
    j = F.regexp_extract(F.coalesce("_response", F.lit("")), r"(?s)(\{.*\})", 1)
    one = _category(F.get_json_object(j, "$.primary_category"), F.get_json_object(j, "$.secondary_category"))
    return got.withColumn("_c", one).withColumns({c: F.col("_c")[c] for c in ("primary_category", "secondary_category")}).drop("_c", "_response")
