"""Problem 3: test items that stand wholly or in part in a corpus.

A document holds an item if an unbroken run of at least half of the item's words (rounded up) stands in it. Words
are runs of letters or digits after Unicode folding; case, spacing, punctuation, math commands and invisible characters
don't count. Items without words are never held; null and empty documents hold none.

Method: Wu-Manber multi-pattern search over words. Any such run begins with the first m words of one of the item's
windows, where m is the smallest half among items of like length; these prefixes are the patterns. The shift table says
for each block of two neighbouring words how far the search may jump; a block that ends a pattern selects the bucket of
patterns with this suffix; each is then compared directly and widened to the longest run. Items are grouped into
classes by length, so a short item doesn't shorten the jumps made for long ones.

The patterns are those of the test items only: `max_items` and `max_chars` bound what is sent to the executors, and more items are
searched in blocks of that size, each block against all documents.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.runtime import require, spread, table

_COMMAND = re.compile(r"\\[A-Za-z]+")
_WORD = re.compile(r"[^\W_]+")
_ENTITY = re.compile(r"&#?\w{2,8};?")
_SCRIPTS = {ord(c): " " + d for digits in ("⁰¹²³⁴⁵⁶⁷⁸⁹", "₀₁₂₃₄₅₆₇₈₉") for c, d in zip(digits, "0123456789")}
#: Characters of general category Cf and combining joiners that are dropped, also inside a word.
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿\U000e0000-\U000e0fff]")


def words(text: str | None) -> list[str]:
    """The words that count, folded."""
    if not text:
        return []
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text.translate(_SCRIPTS)))
    if "&" in text:
        text = _ENTITY.sub(lambda m: x if (x := html.unescape(m[0])) != m[0] else m[0], text)
        text = _INVISIBLE.sub("", text)
    if "\\" in text:
        text = _COMMAND.sub(" ", text)
    return _WORD.findall(text.casefold())


class WuManber:
    """Searches texts of words for runs of half of an item's words or more."""

    BLOCK = 2

    def __init__(self, items: Iterable[tuple[str, str | None]]):
        self.ids: dict[str, int] = {}
        self.items: list[tuple[str, list[int], int]] = []
        for name, text in items:
            if w := words(text):
                self.items.append((name, [self.ids.setdefault(x, len(self.ids) + 1) for x in w], -(-len(w) // 2)))
        classes = defaultdict(list)
        for k, (_, _, need) in enumerate(self.items):
            classes[need.bit_length() if need > 2 else need].append(k)
        self.base = len(self.ids) + 2
        self.classes = [self._tables(own) for own in classes.values()]

    def _tables(self, own: list[int]) -> tuple[int, dict[int, int], dict[int, list[tuple[int, int]]]]:
        m = min(self.items[k][2] for k in own)
        block = min(self.BLOCK, m)
        shift: dict[int, int] = {}
        bucket: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k in own:
            _, w, need = self.items[k]
            code = w if block == 1 else [a * self.base + b for a, b in zip(w, w[1:])]
            for at in range(len(w) - need + 1):
                last = at + m - block
                for i in range(at, last + 1):
                    if shift.get(code[i], m) > last - i:
                        shift[code[i]] = last - i
                bucket[code[last]].append((k, at))
        return m, shift, dict(bucket)

    def find(self, text: str | None) -> set[str]:
        get = self.ids.get
        doc = [get(w, 0) for w in words(text)]
        pairs = [a * self.base + b for a, b in zip(doc, doc[1:])]
        found: set[str] = set()
        for m, shift, bucket in self.classes:
            block = min(self.BLOCK, m)
            codes = doc if block == 1 else pairs
            jump, at, end = m - block + 1, m - block, len(codes)
            while at < end:
                s = shift.get(codes[at], jump)
                if s:
                    at += s
                    continue
                begin = at - (m - block)
                for k, p in bucket.get(codes[at], ()):
                    name, w, need = self.items[k]
                    if name not in found and doc[begin : begin + m] == w[p : p + m]:
                        a, b = begin, begin + m
                        q = p + m
                        while b < len(doc) and q < len(w) and doc[b] == w[q]:
                            b, q = b + 1, q + 1
                        while a > 0 and p > 0 and doc[a - 1] == w[p - 1]:
                            a, p = a - 1, p - 1
                        if b - a >= need:
                            found.add(name)
                at += 1
        return found


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "item_text", max_items: int = 20_000, max_chars: int = 32_000_000) -> DataFrame:
    """(key, item) of each item that a document holds, each once.

    items has a row an item or form of it; several rows of one item count as its forms. Items are read to the driver in
    blocks by hash, of about half of max_items rows and max_chars characters, and each block is searched in all documents; a block that
    outgrows a bound all the same (one item may) is an error.
    """
    require(docs, key, text)
    require(items, item, item_text)
    items = items.select(item, item_text).filter(F.col(item).isNotNull() & F.col(item_text).isNotNull())
    items = items.distinct()
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length(item_text)), F.lit(0))).first()
    blocks = max(1, -(-n // (max_items // 2)), -(-chars // (max_chars // 2)))
    kind = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField(item, T.StringType())])
    src = spread(docs.select(key, text).filter(F.col(text).isNotNull()))
    out = None
    for b in range(blocks):
        rows = [(str(i), t) for i, t in items.filter(F.pmod(F.xxhash64(item, item_text), F.lit(blocks)) == b).sort(item, item_text).limit(max_items + 1).collect()]
        if len(rows) > max_items or sum(len(t) for _, t in rows) > max_chars:
            raise ValueError(f"a block of test items has more than {max_items} rows or {max_chars} characters")
        sent = src.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            search = WuManber(sent.value)
            for batch in batches:
                ids, at = [], []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    for name in sorted(search.find(t)):
                        at.append(i)
                        ids.append(name)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(ids, pa.string())], names=[key, item])

        part = src.mapInArrow(run, kind)
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def test_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "bench_eval_data").select("item_id", F.col("question").alias("item_text"))
    return a.unionByName(table(spark, sf_dir, "math_100").select("item_id", F.col("problem").alias("item_text")))


def found_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), test_items(spark, sf_dir))


def items_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items with the number of documents that hold them."""
    return found_query(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_docs"))
