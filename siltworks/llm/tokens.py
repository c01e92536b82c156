"""Problem 8: encoding with a public byte-level BPE, read from a rank file.

Method: the tiktoken library with the local rank file. Its pre-splitting pattern never matches across the border
between a character that is not white space and one that is, so long texts are cut there without changing any id.
Nulls and empty texts have an empty list of ids. Decoding joins the tokens' raw bytes before it reads them as UTF-8.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.runtime import require, spread

#: The public files' folder; every function takes another path.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
#: Fixed value: the pre-splitting pattern that belongs to the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a text that the library gets in one call.
PART = 200_000
_BORDER = re.compile(r"(?<=\S)(?=\s)")


def rank_file(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return f"{folder or TOKENIZERS}/{name}.tiktoken"


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, part: int = PART) -> Iterator[str]:
    """Parts of about `part` characters, cut only where the pattern always has a border."""
    at = 0
    while len(text) - at > part:
        if not (m := _BORDER.search(text, at + part)):
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode(text: str | None, path: str) -> list[int]:
    if not text:
        return []
    e = encoding(path)
    if len(text) <= PART:
        return e.encode_ordinary(text)
    return [i for p in safe_parts(text) for i in e.encode_ordinary(p)]


def decode(ids: list[int] | None, path: str) -> str:
    """The text of any list of ids; bytes that aren't UTF-8 (a list cut inside a character) become U+FFFD."""
    e = encoding(path)
    return b"".join(e.decode_single_token_bytes(int(i)) for i in ids if i is not None).decode("utf-8", "replace") if ids is not None else ""


def encode_column(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids) of each row; an empty list for an empty and for a null text. Other columns aren't read."""
    require(df, key, text)
    path = path or rank_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [encode(t, path) for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.fromiter((i for x in ids for i in x), np.int32, offsets[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"])

    kind = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return spread(df.select(key, text)).mapInArrow(run, kind)


def count_tokens(column: Column, path: str | None = None) -> Column:
    """Number of tokens of a text column; 0 for null."""
    path = path or rank_file()

    @F.pandas_udf(T.LongType())
    def n(texts):
        import pandas as pd

        return pd.Series([len(encode(t, path)) for t in texts], dtype="int64")

    return n(column)


def decode_column(column: Column, path: str | None = None) -> Column:
    path = path or rank_file()

    @F.pandas_udf(T.StringType())
    def text(ids):
        import pandas as pd

        return pd.Series([decode(i, path) for i in ids], dtype=object)

    return text(column)


def ids_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_column(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def roundtrip_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per result of decoding their ids again; every document must come out `same`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ids = count_and_text(docs)
    return ids.groupBy("same").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))


def count_and_text(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    path = path or rank_file()

    @F.pandas_udf("same boolean, n_tokens bigint")
    def both(texts):
        import pandas as pd

        ids = [encode(t, path) for t in texts]
        return pd.DataFrame({"same": [decode(i, path) == (t or "") for i, t in zip(ids, texts)], "n_tokens": [len(i) for i in ids]})

    return spread(df.select(text)).select(both(F.col(text)).alias("r")).select("r.*")
