"""Problem 9: items of varying length in containers of fixed capacity.

Method: vector bin packing by the dot-product heuristic. An item is a vector (tokens, segments = 1, loss-bearing
tokens) and a container has a limit for each; the container that is open takes, of the items that still fit, the one
whose vector has the largest dot product with the room left, each dimension divided by its limit and weighted by
the demand for it over all items. A container closes when nothing fits any more. Documents have a limit of tokens only, so for
them the largest item that fits is taken; instruction pairs have all three limits.

Items are split only if they exceed a limit: they give full pieces and a rest. Pieces that fill a container are one of
their own. All others are dealt to shards by the hash of their key; a shard is packed in one task and holds about
`shard_items` items whatever the input's size, so a hot source or size can't grow a task. Each shard leaves at most
a few containers that aren't full. Items with equal vectors are interchangeable and are searched as one, so a step costs
the number of different vectors. Null or negative sizes count as 0. Items of size 0 get a container like all others.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.llm.tokens import count_tokens, rank_file
from siltworks.runtime import durable, require, spread, table

SHARD_ITEMS = 8192
#: name, capacity in tokens, most segments of a container or None, most loss-bearing tokens or None
Spec = tuple[str, int, int | None, int | None]


def dot_product_pack(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Container numbers of the items, each a row of sizes; no item may exceed a limit.

    Two forms of the heuristic are tried and the one that needs fewer containers counts: the plain product, which takes large items
    first, and the product by the item's length with the room weighted by what is still to be packed, which keeps the mix of items even. Where
    only one limit matters they are the same, and only the first is tried.
    """
    if not len(sizes):
        return np.full(0, -1, np.int64)
    first = _packed(sizes, limits, False)
    scaled = sizes / limits
    demand = scaled.sum(0)
    matter = scaled[:, demand > 0.25 * max(demand.max(), 1e-12)]
    if matter.shape[1] < 2 or np.allclose(matter, matter[:, :1]):
        return first
    other = _packed(sizes, limits, True)
    return other if other.max() < first.max() else first


def _packed(sizes: np.ndarray, limits: np.ndarray, even: bool) -> np.ndarray:
    n = len(sizes)
    out = np.full(n, -1, np.int64)
    kinds, of = np.unique(sizes, axis=0, return_inverse=True)
    of = of.ravel()
    order = np.argsort(of, kind="stable")
    start = np.searchsorted(of[order], np.arange(len(kinds)))
    left = np.bincount(of, minlength=len(kinds))
    scaled = kinds / limits
    demand = (scaled * left[:, None]).sum(0)
    weight = demand / max(demand.sum(), 1e-12)
    by_room = scaled * weight
    if even:
        by_room = by_room / np.maximum(np.sqrt((scaled**2 * weight).sum(1)), 1e-12)[:, None]
    bin_no, room, live = 0, limits.astype(np.float64).copy(), np.arange(len(kinds))
    while n:
        fits = live[(kinds[live] <= room).all(1)]
        if not len(fits):
            bin_no, room = bin_no + 1, limits.astype(np.float64).copy()
            continue
        want = room / limits * (demand if even else 1.0)
        k = fits[np.argmax(by_room[fits] @ want)]
        out[order[start[k]]] = bin_no
        start[k] += 1
        left[k] -= 1
        n -= 1
        room = room - kinds[k]
        demand = demand - scaled[k]
        if not left[k]:
            live = live[live != k]
    return out


def pack(items: DataFrame, specs: Sequence[Spec], key: str, tokens: str = "n_tokens", loss: str | None = None, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(spec_name, key, piece, first_token, n_tokens, n_loss, container) of every piece of every item.

    items: one row an item. specs: see Spec; a limit that is None doesn't bind. An item's loss-bearing tokens are its last ones; without
    a loss column every token bears loss. An item with more of them than a container takes is cut so that no piece has more. piece counts from 0.
    """
    require(items, key, tokens, *([loss] if loss else []))
    size = F.greatest(F.coalesce(F.col(tokens).cast("bigint"), F.lit(0)), F.lit(0))
    loss_size = F.least(F.greatest(F.coalesce(F.col(loss).cast("bigint"), F.lit(0)), F.lit(0)), F.col("_n")) if loss else F.col("_n")
    base = durable(items.select(F.col(key), size.alias("_n")) if not loss else items.withColumn("_n", size).select(F.col(key), "_n", loss_size.alias("_loss")))
    if not loss:
        base = base.withColumn("_loss", F.col("_n"))
    shards = max(1, -(-base.count() // shard_items))
    kinds = F.array(*[F.struct(F.lit(s).alias("spec_name"), F.lit(int(c)).cast("bigint").alias("cap"), F.lit(int(m or 2**31 - 1)).alias("segs"), F.lit(int(q or c)).cast("bigint").alias("most")) for s, c, m, q in specs])
    each = base.select(key, "_n", "_loss", F.explode(kinds).alias("_s")).select(key, "_n", "_loss", "_s.*")
    # an item whose loss exceeds the limit is cut at the finer of both
    step = F.when(F.col("_loss") > F.col("most"), F.least("cap", "most")).otherwise(F.col("cap"))
    each = each.withColumn("_step", step)
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_n") / F.col("_step")).cast("int") - 1, F.lit(0)))
    cut = each.withColumn("piece", F.explode(pieces)).withColumn("first_token", F.col("piece") * F.col("_step"))
    cut = cut.withColumn("n_tokens", F.least(F.col("_step"), F.col("_n") - F.col("first_token")))
    cut = cut.withColumn("n_loss", F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("first_token") + F.col("n_tokens") - (F.col("_n") - F.col("_loss")))))
    full = cut.filter(F.col("n_tokens") == F.col("cap"))
    rest = cut.filter(F.col("n_tokens") < F.col("cap")).withColumn("_shard", F.pmod(F.xxhash64(F.col(key), F.col("piece")), F.lit(shards)))
    kind = T.StructType([T.StructField("spec_name", T.StringType()), T.StructField(key, items.schema[key].dataType), T.StructField("piece", T.IntegerType())] + [T.StructField(c, T.LongType()) for c in ("first_token", "n_tokens", "n_loss")] + [T.StructField("container", T.StringType())])

    def run(name: tuple, g: pd.DataFrame) -> pd.DataFrame:
        cap, segs, most = (int(g[c].iloc[0]) for c in ("cap", "segs", "most"))
        g = g.sort_values([key, "piece"], kind="stable")
        v = np.stack([g["n_tokens"].to_numpy(), np.ones(len(g), np.int64), g["n_loss"].to_numpy()], axis=1)
        at = dot_product_pack(v, np.array([cap, segs, most], np.int64))
        return pd.DataFrame({"spec_name": name[0], key: g[key], "piece": g["piece"], "first_token": g["first_token"], "n_tokens": g["n_tokens"], "n_loss": g["n_loss"], "container": [f"s{name[1]}-{b}" for b in at]})

    packed = rest.groupBy("spec_name", "_shard").applyInPandas(run, kind)
    whole = full.select("spec_name", key, "piece", "first_token", "n_tokens", "n_loss", F.concat(F.lit("f-"), F.col(key).cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("container"))
    return packed.unionByName(whole)


def fill(packed: DataFrame, specs: Sequence[Spec]) -> DataFrame:
    """(spec_name, container, n_pieces, used_tokens, unused_tokens, fill) of every container."""
    cap = F.create_map(*[x for s, c, *_ in specs for x in (F.lit(s), F.lit(int(c)).cast("bigint"))])[F.col("spec_name")]
    g = packed.groupBy("spec_name", "container").agg(F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("used_tokens"), F.sum("n_loss").alias("loss_tokens"))
    return g.withColumn("unused_tokens", cap - F.col("used_tokens")).withColumn("fill", F.col("used_tokens") / cap)


def read_specs(spark: SparkSession, sf_dir: str, segments: int | None = None, loss_share: float | None = None) -> list[Spec]:
    """The containers' capacities: a table of settings with a row a kind of container; more than 1,000 rows, a null name, two of one name or a capacity that isn't positive are an error."""
    rows = table(spark, sf_dir, "pack_specs").select("spec_name", "capacity_tokens").distinct().limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("pack_specs is a table of settings; it has more than 1,000 rows")
    if bad := [tuple(r) for r in rows if r[0] is None or r[1] is None or r[1] <= 0]:
        raise ValueError(f"pack_specs has rows that describe no container: {bad[:5]}")
    if len({r[0] for r in rows}) < len(rows):
        raise ValueError("pack_specs has two capacities under one name")
    return sorted((r[0], r[1], segments, max(1, int(r[1] * loss_share)) if loss_share else None) for r in rows)


def quality(packed: DataFrame, specs: Sequence[Spec]) -> DataFrame:
    """(spec_name, containers, lower_bound, fill): the containers used, the least number that any packing needs by the demand for each limit, and the mean fill in tokens."""
    limit = F.create_map(*[x for s, c, m, q in specs for x in (F.lit(s), F.struct(F.lit(float(c)).alias("c"), F.lit(float(m or 2**31 - 1)).alias("m"), F.lit(float(q or c)).alias("q")))])[F.col("spec_name")]
    g = packed.groupBy("spec_name").agg(F.countDistinct("container").alias("containers"), F.sum("n_tokens").alias("t"), F.count("*").alias("n"), F.sum("n_loss").alias("l"))
    bound = F.greatest(F.ceil(F.col("t") / limit["c"]), F.ceil(F.col("n") / limit["m"]), F.ceil(F.col("l") / limit["q"]))
    return g.select("spec_name", "containers", bound.alias("lower_bound"), (F.col("t") / (F.col("containers") * limit["c"])).alias("fill"))


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spread(docs).select("doc_id", count_tokens(F.col("text"), rank_file()).alias("n_tokens"))


def documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(document_items(spark, sf_dir), read_specs(spark, sf_dir), "doc_id").drop("n_loss")


def containers_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = read_specs(spark, sf_dir)
    return fill(pack(document_items(spark, sf_dir), specs, "doc_id"), specs).drop("loss_tokens")


def instruction_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, n_tokens, n_loss) of each instruction pair; the tokens of the output bear loss."""
    rows = table(spark, sf_dir, "raw_code").groupBy("pair_id").agg(F.max(F.struct("instruction", "input", "output")).alias("r")).select("pair_id", "r.*")
    n = lambda c: count_tokens(F.col(c), rank_file())
    items = spread(rows).select("pair_id", (n("instruction") + n("input")).alias("_p"), n("output").alias("n_loss"))
    return items.select("pair_id", (F.col("_p") + F.col("n_loss")).alias("n_tokens"), "n_loss")


#: Limits of the containers of instruction pairs: segments, and loss-bearing tokens as a share of the capacity.
SEGMENTS, LOSS_SHARE = 12, 0.75


def instructions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction pairs under all three limits: tokens, SEGMENTS segments, and LOSS_SHARE of the capacity in loss-bearing tokens."""
    return pack(instruction_items(spark, sf_dir), read_specs(spark, sf_dir, SEGMENTS, LOSS_SHARE), "pair_id", loss="n_loss")


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill against the lower bound, of the documents and of the instruction pairs."""
    specs, own = read_specs(spark, sf_dir), read_specs(spark, sf_dir, SEGMENTS, LOSS_SHARE)
    a = quality(pack(document_items(spark, sf_dir), specs, "doc_id"), specs).select(F.lit("documents").alias("items"), "*")
    return a.unionByName(quality(pack(instruction_items(spark, sf_dir), own, "pair_id", loss="n_loss"), own).select(F.lit("instructions").alias("items"), "*"))
