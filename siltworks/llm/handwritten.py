"""Problem 1: files that nobody wrote by hand: generated, minified, vendored, or data saved as code.

Method: a file's tokens, comments left out, give shingles of five, with identifiers and literals masked and as they are.

* Generated: a family of units that are equal when masked makes up the file (its shingles are few and nearly all occur equally
  often), or the generator says so in a comment. Families of whole files within a repository don't tell: see the README's figures.
* Data: masked, the file is literals and punctuation only; of those, what is random-looking or rows of plain literals
  is data, and the rest is configuration.
* Minified: most characters stand in long lines without white space.
* Vendored: clusters over several repositories, on shingles that keep their identifiers. Files are alike if SIMILAR or more of
  the smaller set of shingles is in the other, so that local additions don't part copies. Candidates come from a prefix filter,
  which misses no such pair: of a set's shingles, rarest first, one of the first n - SIMILAR n + 1 is in every set that holds
  SIMILAR of it. MinHash bands miss some (see the README).

Copies with equal tokens are one class from the start, with the least and the greatest repository of the class, so a class
may hold any share of the files. In a bucket (a rare shingle) each class is first held against the largest one; then only classes
that aren't known to be alike by that are held against each other, so hot libraries make few pairs and no link between clusters
is lost at any size. All of it is joins; a bucket's members are never gathered. Null and blank texts are never cases.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from siltworks.llm.conversations import components
from siltworks.runtime import Scratch, durable, require, sift, spread, table

SHINGLE, SIMILAR = 5, 0.8
#: Keywords that aren't masked.
KEYWORDS = frozenset("def return if for in while class else elif try except finally raise import from as with lambda yield not and or is None True False int char const static void public private protected final func var let function new switch case default break continue throw package type struct map range len append string float64 bool double long short unsigned signed size_t sizeof typedef enum include define interface extends implements this self null true false async await export exports require module then fi do done local echo set".split())
#: What generators write about their output, by language.
STATEMENTS = (r"code generated by .{1,80}?do not edit", r"@generated\b", r"<auto-?generated", r"^\W*auto-?generated\b", r"\bauto-?generated (?:file|from|by|code)\b", r"\bautomatically (?:generated|created|produced|written) (?:by|from)\b", r"^\W*(?:(?:this|the) (?:file|code|source|module) (?:is|was|has been) )?(?:generated|produced|created|written|emitted|compiled) by [\w./-]+ v?\d[\w.]*\b", r"\brun .{2,40} to (?:refresh|regenerate|rebuild|update) (?:this|the) file", r"\bthis file (?:was|is|has been) (?:auto\w*[ -]?)?(?:generated|machine[- ]\w+)", r"\bgenerated (?:file|code|source)\b.{0,40}\b(?:do not|don't|never) (?:edit|change|modify)", r"automatisch (?:erzeugt|generiert|erstellt)", r"(?:produite?|générée?|créée?) automatiquement", r"(?:generad|cread|producid)[oa] automáticamente", r"automáticamente (?:generad|cread)", r"(?:gerad|criad|produzid)[oa] automaticamente", r"автоматически (?:сгенерирован|создан|сформирован)|(?:сгенерирован|создан|сформирован)\w* автоматически", r"自动(?:生成|产生)", r"自動(?:的に)?(?:生成|作成)")

#: One of these is part of each statement.
_HINTS = ("generated", "automat", "auto-gen", "produced", "created by", "written by", "emitted by", "compiled by", "to refresh", "to regenerate", "to rebuild", "to update", "自动", "自動", "автомат", "produit")
_STATED = re.compile("|".join(STATEMENTS), re.I)
_NOTE = re.compile(r"^\s*(?:#|//|/\*|\*|<!--|--|;|\"\"\")")
_TAIL = r"|0[xX][0-9a-fA-F]+|\d[\w.]*|[^\W\d][\w$]*|[^\s\w]"
_STRINGS = r'"""[\s\S]*?(?:"""|\Z)|\'\'\'[\s\S]*?(?:\'\'\'|\Z)|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`[^`]*`'
_HASH = re.compile(_STRINGS + r"|#[^\n]*" + _TAIL)
_SLASH = re.compile(_STRINGS + r"|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)" + _TAIL)
#: A comment or string with a sentence in it: a repeated unit with sentences of its own is somebody's work.
_PROSE = re.compile(r"(?:(?:#|//|\*|\"\"\")\s*|[\"'])(?:(?:[^\W\d_]{1,20}['’,]?\s){6}[^\"'\n]*|[^\"'\n]*[぀-鿿]{8,}[^\"'\n]*)")
#: Keywords that only code has; a unit without any is configuration.
_CODE = frozenset("def return func function class switch throw raise except catch await async lambda typedef struct include static void export import const".split())
_HASHED = (".py", ".sh", ".yaml", ".yml", ".bash", ".rb", ".pl", ".toml")
_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]+-----[\s\S]*?-----END [A-Z0-9 ]+-----")
_RANDOM = re.compile(r"[A-Za-z0-9+/=_-]{20,}|(?:\\x[0-9a-fA-F]{2}){4,}|(?:0x[0-9a-fA-F]{1,2},?\s*){4,}")
_PLAIN = re.compile(r"\b\d[\d.]*\b|[\"'][A-Za-z0-9]{1,12}[\"']|[\"'][\d.]+[\"']|^[\w.,;\t-]*\d[\w.,;\t-]*$", re.M)


def tokens(text: str, path: str | None) -> list[str]:
    """Tokens without comments. A file's ending says which kind of comment it has."""
    rx = _HASH if (path or "").lower().removesuffix(".bak").endswith(_HASHED) or text.startswith("#!") else _SLASH
    return [t for t in rx.findall(text) if t[0] != "#" or rx is _SLASH] if rx is _HASH else [t for t in rx.findall(text) if not t.startswith(("//", "/*"))]


class _Codes(dict):
    """token -> (its code, its code with identifiers and literals masked), worked out once a worker."""

    def __missing__(self, t: str) -> tuple[int, int]:
        if len(self) > 500_000:
            self.clear()
        self[t] = c = (xxhash.xxh64_intdigest(t), xxhash.xxh64_intdigest(_kind(t)))
        return c


_CODES = _Codes()


def _coded(toks: list[str]) -> np.ndarray:
    return np.array([_CODES[t] for t in toks], np.uint64).reshape(-1, 2)


def _shingles(codes: np.ndarray) -> np.ndarray:
    n = max(1, len(codes) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        part = codes[k : k + n]
        out[: len(part)] = (out[: len(part)] * np.uint64(0x9E3779B97F4A7C15)) ^ (part + np.uint64(0x632BE59BD9B4E019 * (k + 1) % 2**64))
    out ^= out >> np.uint64(31)
    return out * np.uint64(0xD6E8FEB86659FD93)


def literal_only(toks: list[str]) -> bool:
    """Whether the masked tokens are literals and punctuation, but for the one or two names that the data are assigned to."""
    return sum(_kind(t) == "I" for t in toks) <= 2


def _kind(t: str) -> str:
    c = t[0]
    return "S" if c in "\"'`" else "0" if c.isdigit() else "I" if (c.isalpha() or c in "_$") and t not in KEYWORDS else t


def repeated_unit(masked: np.ndarray) -> bool:
    """Whether one unit makes up the file, by its fully masked codes: its shingles are few and nearly all occur equally often."""
    if len(masked) < 60:
        return False
    s = _shingles(masked)
    _, n = np.unique(s, return_counts=True)
    if len(n) > 0.3 * len(s):
        return False
    mass = Counter()
    for v in n.tolist():
        mass[v] += v
    k = max(mass, key=lambda v: (mass[v], v))
    return k >= 4 and sum(m for v, m in mass.items() if v >= k) >= 0.72 * len(s)


def blob(text: str) -> bool:
    """Data saved as code: mostly random-looking runs (integrity sums, encoded bytes) or mostly rows of plain literals."""
    t = _PEM.sub("", text)
    if len(t) < 120:
        return False
    random_ = sum(len(x) for x in _RANDOM.findall(t) if any(c.isdigit() for c in x) and (any(c.isupper() for c in x) or re.fullmatch(r"[0-9a-f]+", x) or "\\x" in x or "0x" in x))
    if random_ > 0.45 * len(t):
        return True
    rest = len(re.sub(r"[\s,\[\]{}();|:]", "", t))
    if sum(map(len, _PLAIN.findall(t))) < 0.55 * rest:
        return False
    toks = [t if not t.startswith(('"""', "'''")) else "S" for t in _SLASH.findall(t)]
    values = [x for x in toks if x[0].isdigit() or x[0] in "\"'`" or x[0].isalpha()]
    s = _shingles(_coded(toks)[:, 1])
    own = len(np.unique(s))
    return len(values) >= 40 and own < 0.12 * len(s) or any(x.startswith(('"""', "'''", "`")) and len(x) > 0.7 * len(t) for x in _SLASH.findall(t))


def minified(text: str) -> bool:
    """Most characters stand in very long lines with hardly any white space."""
    long = [x for x in text.splitlines() if len(x) > 250]
    size = sum(map(len, long))
    return size > 0.6 * len(text) and (sum(x.count(" ") + x.count("\t") for x in long) < 0.09 * size or sum(x.count(";") for x in long) > 0.03 * size)


def stated(text: str) -> bool:
    """A comment says that a tool wrote the file."""
    low = text.lower()
    if not any(k in low for k in _HINTS):
        return False
    return any(_NOTE.match(x) and _STATED.search(x) for x in text.splitlines())


def profile(text: str | None, path: str | None) -> tuple[str | None, str | None, np.ndarray | None]:
    """(kind by the file alone, token class, unmasked shingles); nothing for a blank text."""
    if not text or not text.strip():
        return None, None, None
    toks = tokens(text, path)
    kind = "generated" if stated(text) else "minified" if minified(text) else "data" if literal_only(toks) and blob(text) else None
    if kind or not toks:
        return kind, None, None
    codes = _coded(toks)
    if len(_PROSE.findall(text)) < 2 and not _CODE.isdisjoint(toks) and repeated_unit(codes[:, 1]):
        return "generated", None, None
    full = np.ascontiguousarray(codes[:, 0])
    shingles = np.unique(_shingles(full))
    return kind, xxhash.xxh128_hexdigest(full.tobytes()), np.unique((shingles >> np.uint64(32)).astype(np.uint32)).view(np.int32)


def profiles(df: DataFrame, key: str = "id", text: str = "text", path: str = "file_path", repo: str = "repo_name") -> DataFrame:
    """(key, repo, kind, cls, shingles) of each row; repo is repo_name or the two path parts after repos/."""
    require(df, key, text, path, repo)
    kind = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("repo", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("cls", T.StringType()), T.StructField("shingles", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [profile(t, p) for t, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            sizes = np.cumsum([0] + [len(g[2]) if g[2] is not None else 0 for g in got], dtype=np.int32)
            flat = np.concatenate([g[2] for g in got if g[2] is not None] or [np.zeros(0, np.int32)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string()), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))], names=[key, "repo", "kind", "cls", "shingles"])

    name = F.coalesce(F.col(repo), F.nullif(F.regexp_extract(F.coalesce(F.col(path), F.lit("")), r"repos/([^/]+/[^/]+)/", 1), F.lit("")))
    return spread(df.select(key, text, path, name.alias("repo")).filter(F.length(F.trim(text)) > 0)).mapInArrow(run, kind)


def links(classes: DataFrame, files: DataFrame, key: str, similar: float = SIMILAR) -> DataFrame:
    """(a, b) of classes with verified similarity; their components are those of all similar pairs.

    Rows of shingles that stand in one class only are dropped at once; they count for the prefix as the rarest ones.
    """
    with Scratch(files.sparkSession) as scratch:
        return _links(classes, files, key, similar, scratch.put)


def _links(classes: DataFrame, files: DataFrame, key: str, similar: float, put: Callable[[DataFrame], DataFrame]) -> DataFrame:
    size = files.filter("cls IS NOT NULL").select("cls", F.size("shingles").alias("n")).groupBy("cls").agg(F.max("n").alias("n"))
    ids = put(classes.select("cls", F.col("rep").alias(key)).join(size, "cls").orderBy("n").withColumn("i", F.monotonically_increasing_id()))
    # i grows with n, so of two classes the one of the lesser i isn't the larger one
    sets = put(files.filter("cls IS NOT NULL").select(key, "cls", "shingles").join(ids.select(key, "cls", "i"), [key, "cls"]).dropDuplicates([key, "cls"]).select("i", "shingles"))
    each = sets.select("i", F.explode("shingles").alias("h")).withColumn("f", F.count("*").over(W.partitionBy("h"))).filter("f > 1")
    # a shingle is written behind its count, in one number: rows are small and sort from rare to frequent
    shared = put(each.select("i", F.shiftleft("f", 32).bitwiseOR(F.col("h").cast("bigint").bitwiseAND(F.lit(2**32 - 1))).alias("h")))
    rare = shared.withColumn("r", F.row_number().over(W.partitionBy("i").orderBy("h"))).withColumn("m", F.count("*").over(W.partitionBy("i"))).join(ids.select("i", "n"), "i")
    rare = put(rare.filter(F.col("r") <= F.col("m") - F.ceil(F.col("n") * similar - 1e-9) + 1).select("h", "i"))
    # few shingles are rare, and few classes are in a pair: the tables with all of them are sifted by these before they are shuffled
    # an inner join, as a semi-join would be planned before the sift
    member = put(sift(shared, "h", rare.select("h")).join(rare.select("h").distinct(), "h").select("h", "i"))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = put(pairs)
        mine, theirs = sift(sets, "i", pairs.select("i")), sift(sets, "i", pairs.select("j"))
        got = pairs.join(mine, "i").join(theirs.select(F.col("i").alias("j"), F.col("shingles").alias("other")), "j")
        both = F.size(F.array_intersect("shingles", "other"))
        return put(got.filter(both / F.least(F.size("shingles"), F.size("other")) >= similar).select("i", "j"))

    lead = member.groupBy("h").agg(F.max("i").alias("j"))
    led = verified(rare.join(lead, "h").filter("i != j").select("i", "j").distinct())
    label = led.groupBy("i").agg(F.max("j").alias("c"))
    small, large = (x.join(label, "i", "left").withColumn("c", F.coalesce("c", "i")) for x in (rare, member))
    large = large.select("h", F.col("i").alias("j"), F.col("c").alias("d"))
    apart = small.select("h", "c").distinct().join(large.select("h", "d").distinct(), "h").filter("c != d")
    pairs = small.join(apart, ["h", "c"]).join(large, ["h", "d"]).filter("i < j").select("i", "j").distinct()
    out = led.unionByName(verified(pairs))
    name = ids.select("i", "cls")
    return durable(out.join(name.withColumnRenamed("cls", "a"), "i").join(name.select(F.col("i").alias("j"), F.col("cls").alias("b")), "j").select("a", "b"))


def not_handwritten(df: DataFrame, key: str = "id") -> DataFrame:
    """(key, kind) of each file that isn't hand-written: generated, minified, data or vendored."""
    files = durable(profiles(df, key))
    classes = durable(files.filter("cls IS NOT NULL AND kind IS NULL").groupBy("cls").agg(F.min("repo").alias("lo"), F.max("repo").alias("hi"), F.min(key).alias("rep")))
    comp = components(links(classes, files, key)).withColumnRenamed("node", "cls")
    named = classes.select("cls", "lo", "hi").join(comp, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    across = named.groupBy("component").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo != hi").select("component")
    vendored = named.join(across, "component", "left_semi").select("cls").withColumn("copied", F.lit(True))
    kind = F.coalesce("kind", F.when(F.col("copied"), F.lit("vendored")))
    return files.select(key, "kind", "cls").join(vendored, "cls", "left").select(key, kind.alias("kind")).filter("kind IS NOT NULL").groupBy(key).agg(F.min("kind").alias("kind"))


def found_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_handwritten(table(spark, sf_dir, "code_input")).select("id")


def kinds_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_handwritten(table(spark, sf_dir, "code_input"))
