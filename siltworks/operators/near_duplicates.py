"""Near-duplicate filters: MinHash, SimHash, n-gram hash and embedding similarity. Each keeps the first row of a group.

A sequential filter that compares with earlier kept rows only depends on the order of rows and can't be distributed. Here
groups are the connected components of verified links, and the row of least order of each is kept; this drops the same rows
save along chains (a like b, b like c, a unlike c), where the sequential filter keeps c.

Exact copies are one class first. Candidates share a key. The classes of a key are held against its leader first, which settles
like ones in linear time; then only classes that aren't known to be alike by that are held against each other, in blocks of a key
(`BLOCK` classes a side), so a hot key is divided among tasks, like texts make no pairs among themselves, nothing is capped, and no link
between groups is lost at any size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions.text import nz
from siltworks.registry import register
from siltworks.runtime import durable, require, spread



def gram_hashes(text: str, n: int, by_word: bool) -> np.ndarray:
    """Different hashes of the character or word n-grams, mixed from their units all at once; of the whole where there are fewer units than n."""
    if by_word:
        import xxhash

        units = np.fromiter(map(xxhash.xxh64_intdigest, text.split()), np.uint64)
    else:
        units = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    m = len(units) - n + 1
    if m < 1:
        units, m = np.concatenate([units, np.full(n - len(units), 2**63, np.uint64)]), 1
    h = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = (h ^ units[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        h = h * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def group_links(links: DataFrame) -> DataFrame:
    """(node, component) of links (a, b): least labels spread over links until nothing changes, with pointer jumps."""
    cur = durable(links.select("a", "b").union(links.select("b", "a")).distinct())
    label = durable(cur.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        near = cur.join(label.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c")).withColumnRenamed("a", "node")
        new = label.join(near, "node").select("node", F.least("component", "c").alias("component"))
        jump = new.select(F.col("node").alias("component"), F.col("component").alias("far"))
        new = durable(new.join(jump, "component", "left").select("node", F.coalesce("far", "component").alias("component")))
        if not new.join(label.withColumnRenamed("component", "old"), "node").filter("component != old").limit(1).count():
            return new
        label = new


#: Classes of a key whose pairs one task makes with as many others; a larger key is dealt to blocks of about this size.
BLOCK = 2048


def leader_links(keys: DataFrame, sketches: DataFrame | None, alike: Callable[[Column, Column], Column]) -> DataFrame:
    """(a, b) links of ids that share a bucket; their components are those of all such links. keys: (id, bucket); sketches: (id, sketch).

    Without sketches, keys have the column `sketch` (of a few bytes), which then goes along with them.
    """
    if sketches is None:
        return _carried_links(durable(keys.distinct()), alike)
    keys = durable(keys.distinct())
    mine = sketches.select(F.col("id").alias("a"), "sketch")
    theirs = sketches.select(F.col("id").alias("b"), F.col("sketch").alias("other"))
    verified = lambda pairs: durable(pairs.join(mine, "a").join(theirs, "b").filter(alike(F.col("sketch"), F.col("other"))).select("a", "b"))
    lead = keys.groupBy("bucket").agg(F.min("id").alias("b"), F.count("*").alias("n")).filter("n > 1")
    led = verified(keys.join(lead.select("bucket", "b"), "bucket").filter("id != b").select(F.col("id").alias("a"), "b").distinct())
    label = led.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("c"))
    own = durable(keys.join(lead.select("bucket"), "bucket", "left_semi").join(label, "id", "left").select("bucket", F.col("id").alias("a"), F.coalesce("c", "id").alias("c")))
    return led.union(_apart(own.join(mine, "a"), own.select("bucket", F.col("a").alias("b"), F.col("c").alias("d")).join(theirs, "b"), alike))


def _carried_links(keys: DataFrame, alike: Callable[[Column, Column], Column]) -> DataFrame:
    lead = keys.groupBy("bucket").agg(F.min("id").alias("b"), F.min_by("sketch", "id").alias("other"), F.count("*").alias("n")).filter("n > 1").drop("n")
    led = durable(keys.join(lead, "bucket").filter((F.col("id") != F.col("b")) & alike(F.col("sketch"), F.col("other"))).select(F.col("id").alias("a"), "b").distinct())
    label = led.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("c"))
    own = durable(keys.join(lead.select("bucket"), "bucket", "left_semi").join(label, "id", "left").select("bucket", F.col("id").alias("a"), "sketch", F.coalesce("c", "id").alias("c")))
    return led.union(_apart(own, own.select("bucket", F.col("a").alias("b"), F.col("c").alias("d"), F.col("sketch").alias("other")), alike))


def _apart(own: DataFrame, theirs: DataFrame, alike: Callable[[Column, Column], Column]) -> DataFrame:
    """Verified pairs of a key's classes with different labels. own: (bucket, a, c, sketch); theirs: (bucket, b, d, other), the same classes."""
    # keys with one label only have nothing left to compare
    open_ = durable(own.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("m")).filter("lo != hi").select("bucket", "m"))
    every = F.explode(F.sequence(F.lit(0), F.col("m") - 1))
    block = lambda c: F.pmod(F.xxhash64(c), F.col("m")).cast("int")
    # each block of a key meets each other: one side is copied to every column of blocks, the other to every row
    x = own.join(open_, "bucket").withColumn("i", block("a")).withColumn("j", every).drop("m")
    y = theirs.join(open_, "bucket").withColumn("j", block("b")).withColumn("i", every).drop("m")
    pairs = x.join(y, ["bucket", "i", "j"]).filter((F.col("b") < F.col("a")) & (F.col("c") != F.col("d")) & alike(F.col("sketch"), F.col("other")))
    return durable(pairs.select("a", "b").distinct())


def _classes(df: DataFrame, text: str, order: str) -> DataFrame:
    """(id, text) of the first row of each different text."""
    first = df.groupBy(F.xxhash64(nz(text)).alias("_h"), F.md5(nz(text)).alias("_m")).agg(F.min(order).alias("id"))
    return df.select(F.col(order).alias("id"), nz(text).alias("t")).join(first.select("id"), "id")


def _keep_first(df: DataFrame, order: str, classes: DataFrame, links: DataFrame) -> DataFrame:
    comp = group_links(links)
    ids = classes.select("id").join(comp.withColumnRenamed("node", "id"), "id", "left").filter(F.col("component").isNull() | (F.col("component") == F.col("id"))).select(F.col("id").alias(order))
    return df.join(ids, order, "left_semi")


def _bands(code: np.ndarray, rows: int) -> np.ndarray:
    """A key for each `rows` neighbouring values of each row of a matrix."""
    out = np.zeros((len(code), code.shape[1] // rows), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows):
            out = (out ^ code[:, k::rows][:, : out.shape[1]].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
        out ^= np.arange(out.shape[1], dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    return out.view(np.int64)


@register("minhash_deduplicate_filter")
def minhash_deduplicate(df: DataFrame, input_key: str, order: str, num_perm: int = 128, threshold: float = 0.9, ngram: int = 5, by_word: bool = False, rows: int = 8) -> DataFrame:
    """First row of each group of texts whose MinHash similarity of n-grams reaches the threshold; candidates share a band of `rows` values."""
    require(df, input_key, order)
    seeds = np.arange(1, num_perm + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            code = np.empty((len(b), num_perm), np.int32)
            for i, t in enumerate(b["t"]):
                g = gram_hashes(t, ngram, by_word)
                least = np.full(num_perm, 2**64 - 1, np.uint64)
                # seeds x grams at once, in parts that stay small for very long texts
                for part in np.array_split(g, max(1, len(g) // 4096)):
                    with np.errstate(over="ignore"):
                        x = (part[None] ^ seeds[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
                    least = np.minimum(least, x.min(1))
                code[i] = (least >> np.uint64(33)).astype(np.int32)
            yield pd.DataFrame({"id": b["id"], "sketch": list(code), "keys": list(_bands(code, rows))})

    classes = durable(_classes(df, input_key, order))
    kind = classes.schema["id"].dataType.simpleString()
    sk = durable(spread(classes).mapInPandas(run, f"id {kind}, sketch array<int>, keys array<bigint>"))
    need = int(np.ceil(threshold * num_perm - 1e-9))
    same = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) >= need
    return _keep_first(df, order, classes, leader_links(sk.select("id", F.explode("keys").alias("bucket")), sk.select("id", "sketch"), same))


@register("simhash_deduplicate_filter")
def simhash_deduplicate(df: DataFrame, input_key: str, order: str, bound: float = 0.1, ngram: int = 3, near: int = 3) -> DataFrame:
    """First row of each group of texts whose 64-bit SimHash differs in at most bound x 64 bits.

    The fingerprint is cut into bits + near parts; two of at most `bits` different bits agree in `near` parts at least, so candidates
    share some `near` parts, and none is missed. Keys of several parts together tell apart far more fingerprints than one part would.
    """
    require(df, input_key, order)
    bits = int(bound * 64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["t"]:
                h = gram_hashes(t, ngram, False)
                votes = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64) * 2 - len(h)
                out.append(int(np.packbits(votes > 0).view(np.int64)[0]))
            yield pd.DataFrame({"id": b["id"], "sketch": out})

    classes = durable(_classes(df, input_key, order))
    kind = classes.schema["id"].dataType.simpleString()
    sk = durable(spread(classes).mapInPandas(run, f"id {kind}, sketch bigint"))
    n = bits + near
    cuts = [round(i * 64 / n) for i in range(n + 1)]
    part = lambda i: F.shiftrightunsigned("sketch", cuts[i]).bitwiseAND(F.lit(2 ** (cuts[i + 1] - cuts[i]) - 1).cast("bigint"))
    keys = F.array(*[F.xxhash64(F.lit(k), *map(part, c)) for k, c in enumerate(combinations(range(n), near))])
    return _keep_first(df, order, classes, leader_links(sk.select("id", "sketch", F.explode(keys).alias("bucket")), None, lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= bits))


@register("ngramhash_deduplicate_filter")
def ngramhash_deduplicate(df: DataFrame, input_key: str, order: str, n_gram: int = 3, diff_size: int = 1) -> DataFrame:
    """First row of each group of texts that share at least diff_size of their different parts, wherever these stand.

    A text is cut into n_gram parts of equal length, what is left over at its end doesn't count. With diff_size 1 all texts with a part
    are one group, so a part is linked with its least text only; with more, pairs that share so many parts are counted.
    """
    require(df, input_key, order)
    classes = durable(_classes(df, input_key, order))
    size = F.floor(F.length("t") / n_gram).cast("int")
    parts = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n_gram - 1)), lambda i: F.md5(F.substr(F.col("t"), i * size + 1, size))))
    each = durable(classes.select("id", parts.alias("ps"))).select("id", F.explode("ps").alias("p"))
    if diff_size <= 1:
        least = each.groupBy("p").agg(F.min("id").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
        links = each.join(least, "p").filter("id != b").select(F.col("id").alias("a"), "b").distinct()
        return _keep_first(df, order, classes, links)
    # texts that share diff_size parts share a set of as many
    sets = F.array(*[F.concat_ws(",", F.array_sort(F.array(*[F.get("ps", F.lit(i)) for i in c]))) for c in combinations(range(n_gram), diff_size)])
    keyed = classes.select("id", parts.alias("ps")).filter(F.size("ps") >= diff_size).select("id", F.explode(F.array_distinct(sets)).alias("p")).filter(F.size(F.split("p", ",")) == diff_size)
    least = keyed.groupBy("p").agg(F.min("id").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return _keep_first(df, order, classes, keyed.join(least, "p").filter("id != b").select(F.col("id").alias("a"), "b").distinct())


@register("sem_deduplicate_filter")
def semantic_deduplicate(df: DataFrame, vector: str, order: str, eps: float = 0.05, planes: int = 12, tables: int = 24, seed: int = 9) -> DataFrame:
    """First row of each group of vectors with cosine similarity of 1 - eps or more; candidates share a table's signs of random planes.

    A pair at the bound of 0.95 shares one with a chance of 1 - (1 - 0.9^planes)^tables, by default over 0.999.
    """
    require(df, vector, order)
    rng = np.random.default_rng(seed)
    some = df.select(F.size(vector).alias("n")).filter("n > 0").limit(1).collect()
    dim = some[0]["n"] if some else 1
    w = rng.standard_normal((dim, planes * tables))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack([np.asarray(v, float) for v in b["v"]]) if len(b) else np.zeros((0, dim))
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            yield pd.DataFrame({"id": b["id"], "sketch": list(x.astype(np.float32)), "keys": list(_bands((x @ w > 0).astype(np.uint8), planes))})

    base = df.select(F.col(order).alias("id"), F.col(vector).alias("v")).filter("v IS NOT NULL")
    kind = base.schema["id"].dataType.simpleString()
    sk = durable(spread(base).mapInPandas(run, f"id {kind}, sketch array<float>, keys array<bigint>"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, x: s + x) >= 1 - eps
    links = leader_links(sk.select("id", F.explode("keys").alias("bucket")), sk.select("id", "sketch"), dot)
    return _keep_first(df, order, df.select(F.col(order).alias("id")), links)
