"""Reading and writing of record files; partitions are Spark's own splits."""

from __future__ import annotations

import re
import zipfile
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = {"json": "json", "jsonl": "json", "ndjson": "json", "csv": "csv", "parquet": "parquet", "orc": "orc", "txt": "text"}
SINGLE = ("pickle", "pkl", "xlsx")


def kind_of(path: str) -> str:
    return path.rstrip("/").rsplit(".", 1)[-1].lower()


def open_source(spark: SparkSession, paths: str | list[str], format_type: str | None = None, suffix: str | None = None, schema: object | None = None, **options: object) -> DataFrame:
    """Rows of files or folders (local, hdfs:// or s3a://); the format is given or that of each path's ending.

    Paths of different formats are read each by its own and put together by column name. A .json file is one array or object, a
    .jsonl file has a record a line; a bad line gives null columns. suffix: only files in the folders whose names end so.
    """
    by: dict[str, list[str]] = defaultdict(list)
    for p in [paths] if isinstance(paths, str) else list(paths):
        by[(format_type or kind_of(p)).lower()].append(p)
    if unknown := sorted(set(by) - {*FORMATS, *SINGLE}):
        raise ValueError(f"no reader for {', '.join(unknown)}; there are {', '.join([*FORMATS, *SINGLE])}")
    out = None
    for kind, some in by.items():
        got = _single(spark, kind, some, schema) if kind in SINGLE else _split(spark, kind, some, suffix, schema, options)
        out = got if out is None else out.unionByName(got, allowMissingColumns=True)
    if out is None:
        raise ValueError("no paths")
    return out


def _split(spark: SparkSession, kind: str, paths: list[str], suffix: str | None, schema: object | None, options: dict) -> DataFrame:
    r = spark.read.option("recursiveFileLookup", "true")
    if schema is not None:
        r = r.schema(schema)
    if suffix:
        r = r.option("pathGlobFilter", f"*{suffix}")
    if kind == "csv":
        r = r.option("header", "true").option("escape", '"').option("multiLine", "true")
    r = r.options(**{k: str(v) for k, v in options.items()})
    # only a file that ends in .json is one array or object; folders and other endings have a record a line
    whole = [p for p in paths if kind == "json" and p.endswith(".json")] if "multiLine" not in options else []
    lines = [p for p in paths if p not in whole]
    parts = ([r.format(FORMATS[kind]).load(lines)] if lines else []) + ([r.option("multiLine", "true").format("json").load(whole)] if whole else [])
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def _single(spark: SparkSession, kind: str, paths: list[str], schema: object | None) -> DataFrame:
    """Formats of one frame a file: a task reads a file. The first file's columns are everyone's."""
    read = read_xlsx if kind == "xlsx" else pd.read_pickle
    if schema is None:
        schema = spark.createDataFrame(read(paths[0])).schema
    names = [f.name for f in schema] if not isinstance(schema, str) else spark.createDataFrame([], schema).columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:
                yield read(p).reindex(columns=names)

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths)).mapInPandas(run, schema)


def read_xlsx(path: str, sheet: int = 1) -> pd.DataFrame:
    """A sheet of a workbook, its first row as names; numbers as such, everything else as text, empty cells null."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iterfind(".//m:t", ns)) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", ns)]
        rows = []
        for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iterfind(".//m:row", ns):
            cells: dict[int, object] = {}
            for c in row.iterfind("m:c", ns):
                letters = re.match(r"[A-Z]+", c.get("r", "A"))[0]
                k = 0
                for x in letters:
                    k = k * 26 + ord(x) - 64
                v, kind = c.find("m:v", ns), c.get("t")
                if kind == "inlineStr":
                    cells[k - 1] = "".join(t.text or "" for t in c.iterfind(".//m:t", ns))
                elif v is not None and v.text is not None:
                    cells[k - 1] = shared[int(v.text)] if kind == "s" else v.text if kind in ("str", "e") else v.text == "1" if kind == "b" else float(v.text)
            rows.append(cells)
    if not rows:
        return pd.DataFrame()
    names = [str(rows[0].get(i, f"column{i + 1}")) for i in range(max(rows[0], default=-1) + 1)]
    out = pd.DataFrame([[r.get(i) for i in range(len(names))] for r in rows[1:]], columns=names)
    for c in names:
        some = out[c].dropna()
        if len(some) and all(isinstance(x, float) and x.is_integer() for x in some) and len(some) == len(out):
            out[c] = out[c].astype("int64")
    return out


def write(df: DataFrame, path: str, format_type: str = "parquet", mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", "true").format(FORMATS[format_type]).save(path)


def rows_of(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def generate_rows(spark: SparkSession, make: Callable[[int], Iterable[dict]], schema: str, partitions: int = 1, batch: int = 1000) -> DataFrame:
    """Rows of a generator: make(p) gives those of partition p, on an executor and again after a lost one, so it must give the same each time."""
    names = spark.createDataFrame([], schema).columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["id"]:
                held: list[dict] = []
                for row in make(int(p)):
                    held.append(row)
                    if len(held) >= batch:
                        yield pd.DataFrame(held, columns=names)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=names)

    return spark.range(0, partitions, 1, partitions).mapInPandas(run, schema)


def open_hub(spark: SparkSession, name: str, schema: str, hub: str = "datasets", **options: object) -> DataFrame:
    """Rows of a public hub's data set, streamed by the hub's own library, which must be installed on the executors."""
    def rows(_: int) -> Iterable[dict]:
        if hub == "datasets":
            from datasets import load_dataset

            yield from load_dataset(name, streaming=True, split=options.get("split", "train"))
        else:
            from modelscope.msdatasets import MsDataset

            yield from MsDataset.load(name, split=options.get("split", "train"))

    return generate_rows(spark, rows, schema)


def open_media(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """(path, modificationTime, length, content) of files of any kind."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(folder)


def open_table(spark: SparkSession, url: str, name: str, key: str | None = None, parts: int = 8, **options: object) -> DataFrame:
    """A table of a database by JDBC; with a numeric key it is read in `parts` ranges of it."""
    r = spark.read.format("jdbc").option("url", url).options(**{k: str(v) for k, v in options.items()})
    if key:
        lo, hi = r.option("query", f"SELECT min({key}) AS lo, max({key}) AS hi FROM {name}").load().first()
        r = r.option("partitionColumn", key).option("lowerBound", str(lo or 0)).option("upperBound", str(hi or 1)).option("numPartitions", str(parts))
    return r.option("dbtable", name).load()


def count_rows(df: DataFrame) -> int:
    """Number of rows; of Parquet and ORC from the files' footers."""
    return df.agg(F.count("*")).first()[0]
