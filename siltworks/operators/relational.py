"""Operators that look at more than one row: deduplication, counting, chunking, formats, joins, coresets."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from siltworks.functions.text import GAP, U, WORD, char_ngrams, let, n_words, ngrams, nz, words
from siltworks.registry import register
from siltworks.runtime import durable, require


def _joined(df: DataFrame, keys: list[str]) -> Column:
    return nz(keys[0]) if len(keys) == 1 else F.concat_ws("\n", *[F.concat(F.lit(f"{k}:\n"), nz(k)) for k in keys])


def _first_of(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The row of least order for each key. Least orders are aggregated before they are joined, so a key may be of any size."""
    least = df.groupBy(key.alias("_k")).agg(F.min(order).alias(order)).select(order)
    return df.join(least.distinct(), order, "left_semi")


@register("hash_deduplicate_filter")
def hash_deduplicate(df: DataFrame, input_keys: list[str], order: str, hash_func: str = "md5") -> DataFrame:
    """First row of each text, by the column `order` (unique)."""
    require(df, order, *input_keys)
    t = _joined(df, input_keys)
    h = {"md5": F.md5(t), "sha256": F.sha2(t, 256), "xxh3": F.xxhash64(t).cast("string")}[hash_func]
    return _first_of(df, h, order)


@register("ccnet_deduplicate_filter")
def ccnet_deduplicate(df: DataFrame, input_keys: list[str], order: str, bit_length: int = 64) -> DataFrame:
    """First row of each prefix of bit_length bits of the SHA-1 sum."""
    return _first_of(df, F.substring(F.sha1(_joined(df, input_keys)), 1, bit_length // 4), order)


@register("value_counts")
def value_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by value; category and difficulty evaluators are this."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


@register("reasoning_token_dataset_evaluator")
def length_statistics(df: DataFrame, key: str) -> DataFrame:
    """Zeros, least, greatest, mean and upper median of the number of words. The median is read off the counts of each length, so rows are only aggregated."""
    require(df, key)
    by = df.groupBy(n_words(key).alias("n")).agg(F.count("*").alias("c"))
    run = by.withColumn("upto", F.sum("c").over(W.orderBy("n"))).withColumn("all", F.sum("c").over(W.partitionBy()))
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("n")))
    return run.agg(F.coalesce(F.sum(F.when(F.col("n") == 0, F.col("c"))), F.lit(0)).alias("zeros"), F.min("n").alias("least"), F.max("n").alias("greatest"), (F.sum(F.col("n") * F.col("c")) / F.sum("c")).alias("mean"), middle.alias("median"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"))


@register("reasoning_pretrain_format_convert")
def pretrain_format(df: DataFrame, question: str, answer: str) -> DataFrame:
    return df.select(F.concat(nz(question), F.lit("\n"), nz(answer)).alias("text"))


def repetition_score(c: Column, n: int = 5) -> Column:
    """Share of different n-grams: of characters (Han, Latin letters, digits) for a text with Han characters, else of words; 0 where there is none."""
    t = F.lower(nz(c))
    han = char_ngrams(F.regexp_replace(t, "[^\u4e00-\u9fff0-9a-z]", ""), n)
    plain = ngrams(words(F.regexp_replace(t, f"{U}[^{WORD}{GAP}]", " ")), n)
    return let(F.when(t.rlike("[\u4e00-\u9fff]"), han).otherwise(plain), lambda g: F.when(F.size(g) == 0, F.lit(0.0)).otherwise(F.size(F.array_distinct(g)) / F.size(g)))


@register("reasoning_answer_ngram_filter")
def answer_ngram(df: DataFrame, question: str, answer: str, min_score: float = 0.1, max_score: float = 1.0, ngrams: int = 5) -> DataFrame:
    """Rows whose question and answer repeat themselves neither too much nor too little. Bounds outside 0 to 1 are set to its ends, crossed ones swapped; an n that isn't positive is 5."""
    require(df, question, answer)
    lo, hi = min_score if 0 <= min_score <= 1 else 0.0, max_score if 0 <= max_score <= 1 else 1.0
    return df.filter(repetition_score(F.concat(nz(question), F.lit(" "), nz(answer)), ngrams if ngrams > 0 else 5).between(min(lo, hi), max(lo, hi)))


@register("answer_token_length_filter")
def answer_length(df: DataFrame, key: str, max_words: int = 8192) -> DataFrame:
    return df.filter(n_words(key).between(1, max_words))


@register("pseudo_answer_vote")
def majority(df: DataFrame, key: str, answer: str, order: str) -> DataFrame:
    """The most frequent answer of each key, the first given one of equals. Counts are aggregated before answers are compared."""
    c = df.filter(F.col(answer).isNotNull()).groupBy(key, answer).agg(F.count("*").alias("votes"), F.min(order).alias("_o"))
    return c.groupBy(key).agg(F.max_by(answer, F.struct(F.col("votes"), -F.col("_o"))).alias(answer), F.max("votes").alias("votes"))


@register("kbc_chunk_generator")
def chunks(df: DataFrame, key: str, text: str, chunk_size: int = 512, chunk_overlap: int = 50) -> DataFrame:
    """Rows of at most chunk_size words each, every one beginning chunk_size - chunk_overlap words after the last."""
    step = chunk_size - chunk_overlap
    w = words(text)
    n = F.size("_w")
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(F.ceil((n - chunk_overlap) / step) - 1, F.lit(0)).cast("int"))).otherwise(F.array().cast("array<int>"))
    return df.select(key, w.alias("_w")).select(key, "_w", F.explode(starts).alias("chunk")).select(key, "chunk", F.array_join(F.slice("_w", F.col("chunk") * step + 1, chunk_size), " ").alias("raw_chunk"))


@register("adjacent_pairs")
def adjacent_pairs(df: DataFrame, partition: str, order: str, text: str) -> DataFrame:
    """Each row with the next one of its partition by `order` (unique in it).

    Rows are dealt to ranges of (partition, order), so a partition of any size is spread; within a range the next row is a window's, and the
    last row of a range gets the first one of the partition's next range.
    """
    require(df, partition, order, text)
    n = max(2, df.sparkSession.sparkContext.defaultParallelism)
    rows = durable(df.select(partition, order, F.col(text).alias("first")).repartitionByRange(n, partition, order).withColumn("_r", F.spark_partition_id()))
    w = W.partitionBy("_r", partition).orderBy(order)
    one = rows.withColumn("_next", F.lead(F.struct("first")).over(w))
    heads = rows.groupBy(partition, "_r").agg(F.min_by(F.struct("first"), order).alias("_head"))
    over = W.partitionBy(partition).orderBy("_r")
    spread_ = heads.withColumn("_head", F.lead("_head").over(over)).filter(F.col("_head").isNotNull()).select(F.col(partition).alias("_k"), F.col("_r").alias("_s"), "_head")
    got = one.join(spread_, one["_next"].isNull() & one[partition].eqNullSafe(F.col("_k")) & (F.col("_r") == F.col("_s")), "left")
    return got.select(partition, order, "first", F.coalesce("_next", "_head")["first"].alias("second")).filter(F.col("second").isNotNull())


@register("union_with_flag")
def union_with_flag(original: DataFrame, synthetic: DataFrame, flag: str = "Synth_or_Input") -> DataFrame:
    return original.withColumn(flag, F.lit("input")).unionByName(synthetic.withColumn(flag, F.lit("synth")), allowMissingColumns=True)


@register("nest_extract")
def nest_extract(df: DataFrame, paths: dict[str, tuple[str, str]], remove_all_keys: bool = False) -> DataFrame:
    """Columns from JSON strings: output -> (input, path such as $.a[0].b); rows with a missing path go."""
    got = {o: F.get_json_object(F.col(i), p) for o, (i, p) in paths.items()}
    out = df.withColumns(got)
    for o in paths:
        out = out.filter(F.col(o).isNotNull())
    return out.select(*paths) if remove_all_keys else out


@register("json_parse_filter")
def json_parse_filter(df: DataFrame, input_key: str, output_key: str, required: tuple[str, ...] = (), ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Rows whose text, without a code fence, is a JSON object with the required paths and values within the ranges."""
    t = F.regexp_replace(nz(input_key), r"^\s*```(?:json)?\s*|\s*```\s*$", "")
    v = F.try_parse_json(t)
    ok = v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT")
    out = df.withColumn(output_key, F.when(ok, t)).filter(F.col(output_key).isNotNull())
    for p in required:
        out = out.filter(F.get_json_object(output_key, f"$.{p}").isNotNull())
    for p, (lo, hi) in (ranges or {}).items():
        out = out.filter(F.get_json_object(output_key, f"$.{p}").cast("double").between(lo, hi))
    return out


def plain_answer(c: Column) -> Column:
    """The words of an answer that count: lower case, without punctuation and articles, divided by spaces."""
    return F.array_join(words(F.regexp_replace(F.regexp_replace(F.lower(nz(c)), r"[!-/:-@\[-`{-~]", ""), rf"(?<![{WORD}])(?:a|an|the)(?![{WORD}])", " ")), " ")


def _f1(p: str, t: str) -> float:
    if p != t and {p, t} & {"yes", "no", "noanswer"}:
        return 0.0
    a, b = p.split(), t.split()
    common = sum((Counter(a) & Counter(b)).values())
    return 2.0 * common / (len(a) + len(b)) if common else 0.0


def token_f1(prediction: Column, *truths: Column) -> Column:
    """Token F1 of an answer, the greatest over its references; yes, no and noanswer must agree. Words are counted, in time linear in them."""
    @F.pandas_udf(T.DoubleType())
    def run(p: pd.Series, *ts: pd.Series) -> pd.Series:
        return pd.Series([max(_f1(x, t) for t in r) for x, *r in zip(p, *ts)], dtype=float)

    return run(plain_answer(prediction), *map(plain_answer, truths))


@register("agenticrag_qaf1_sample_evaluator")
def qa_f1(df: DataFrame, prediction: str = "refined_answer", truth: str = "golden_doc_answer", output: str = "F1Score") -> DataFrame:
    """df with the token F1 against the truth, a text or an array of them (the best counts; none gives 0)."""
    require(df, prediction, truth)
    if not dict(df.dtypes)[truth].startswith("array"):
        return df.withColumn(output, token_f1(F.col(prediction), F.col(truth)))
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    best = rows.select("_row", F.col(prediction).alias("_p"), F.explode(truth).alias("_t")).groupBy("_row").agg(F.max(token_f1(F.col("_p"), F.col("_t"))).alias(output))
    return rows.join(best, "_row", "left").drop("_row").withColumn(output, F.coalesce(output, F.lit(0.0)))


@register("pandas_operator")
def compose(df: DataFrame, functions: list, schema: object | None = None) -> DataFrame:
    """df through each function of frames in turn. With a schema, functions of pandas frames, applied to Arrow batches on executors."""
    if schema is None:
        for f in functions:
            df = f(df)
        return df

    def run(batches):
        for b in batches:
            for f in functions:
                b = f(b)
            yield b

    return df.mapInPandas(run, schema)


@register("load_partition")
def merge_by_id(frames: list[DataFrame], key: str = "id") -> DataFrame:
    """Rows that all frames have, with every column; of a column in several frames the last one's value counts."""
    out = frames[0]
    for f in frames[1:]:
        out = out.drop(*[c for c in f.columns if c != key and c in out.columns]).join(f, key)
    return out
