"""Problem 6: natural language inside source files.

Method: prediction by partial matching. Per language a context tree of orders 0 to ORDER over folded characters (letters of one
case, all digits one, Han, kana and Cyrillic as they are) is counted on labelled rows. A character is coded in the longest context that has
been seen in the language and followed by it, with an escape (method C) for each longer context that was seen without it, so the order
adapts from character to character. Code lengths of the characters and escapes of every context are kept in sorted tables by 64-bit hashes,
for all languages side by side. A span (a comment or a string literal) has the language whose tree codes it in fewest bits; spans
without enough running words, and those that need as many bits a character as random letters of the language do, are undetermined.

The trees are trained on at most `TRAIN_DOCS` labelled documents a language (chosen by the hash of their key), the first TRAIN_CHARS
characters of each; rows that another language's tree codes better after a first training are left out of the second, as some
labels are wrong. Comments and strings are read by the language that the text is really written in. Null and empty texts have no spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.llm.parsing import language_of
from siltworks.runtime import require, spread, table

LANGUAGES = ("de", "en", "es", "fr", "ja", "pt", "ru", "zh")
TRAIN_DOCS, TRAIN_CHARS, WORDS, CJK_CHARS = 320, 2000, 5, 10
#: Longest context; share of random pieces that the limit of undetermined spans may let through.
ORDER, LIMIT_SHARE = 3, 0.02


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """Folded code of each UTF-16 unit."""
    t = np.arange(65536, dtype=np.uint64)
    for c in range(65536):
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        if x.isspace():
            t[c] = 32
        elif x.isdigit():
            t[c] = 48
        elif len(y := x.lower()) == 1:
            t[c] = ord(y)
    return t


def _units(text: str) -> np.ndarray:
    return symbols()[np.frombuffer(text.encode("utf-16-le", "replace"), np.uint16)]


def _hashes(u: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n symbols that end at each place; blanks stand before the first."""
    h = np.full(len(u), n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n - 1, -1, -1):
            x = np.concatenate([np.full(min(k, len(u)), 32, np.uint64), u[: max(0, len(u) - k)]])
            h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def _classes(u: np.ndarray) -> np.ndarray:
    """Class of each symbol: Latin, Cyrillic, kana, Han, other letters, and what isn't a letter."""
    return np.select([(u >= 0x400) & (u < 0x530), (u >= 0x3040) & (u < 0x3100), (u >= 0x3400) & (u < 0xA000), (u >= 97) & (u < 123) | (u >= 0xAA) & (u < 0x250), u >= 0x250], [1, 2, 3, 0, 4], 5)


class _Table:
    """Code lengths by hash, a column a language; 0 where a language hasn't seen the key."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        self.keys = np.unique(np.concatenate([k for k, _ in parts])) if parts else np.zeros(0, np.uint64)
        self.bits = np.zeros((len(self.keys) + 1, len(parts)), np.float16)
        for j, (k, b) in enumerate(parts):
            self.bits[np.searchsorted(self.keys, k), j] = np.maximum(b, 1e-3)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.keys, h)
        there = i < len(self.keys)
        there[there] = self.keys[i[there]] == h[there]
        return self.bits[np.where(there, i, len(self.keys))]


class Trees:
    """Context trees of all languages. bits[n]: of a symbol after its last n, where seen; away[n]: of the escape from a context of n.

    new: bits of a symbol that a language hasn't shown, by its class: as rare as the class there, and one of twice the symbols of the class.
    limit: by language, the bits a character that random symbols need.
    """

    def __init__(self, bits: list[_Table], away: list[_Table], new: np.ndarray, alphabets: list[np.ndarray]):
        self.bits, self.away, self.new, self.alphabets = bits, away, new, alphabets
        self.limit = np.full(len(LANGUAGES), np.inf)

    @classmethod
    def fit(cls, rows: list[tuple[str, str]]) -> Trees:
        bits: list[list] = [[] for _ in range(ORDER + 1)]
        away: list[list] = [[] for _ in range(ORDER + 1)]
        new, alphabets = np.zeros((6, len(LANGUAGES)), np.float32), []
        for j, lang in enumerate(LANGUAGES):
            texts = [_units(t) for la, t in rows if la == lang]
            u = np.concatenate([np.concatenate([x, [np.uint64(32)]]) for x in texts]) if texts else np.zeros(0, np.uint64)
            alphabets.append(np.unique(u))
            share, kinds_of = (np.bincount(_classes(x), minlength=6) + 1 for x in (u, alphabets[-1]))
            new[:, j] = -np.log2(share / share.sum()) + np.log2(2 * kinds_of)
            before = np.concatenate([[np.uint64(32)], u])[: len(u)]
            for n in range(ORDER + 1):
                gram, first, count = np.unique(_hashes(u, n + 1), return_index=True, return_counts=True)
                context, of, total = np.unique(_hashes(before, n), return_inverse=True, return_counts=True)
                own = of.ravel()[first]
                kinds = np.bincount(own, minlength=len(context))
                bits[n].append((gram, -np.log2(count / (total[own] + kinds[own]))))
                away[n].append((context, -np.log2(kinds / (total + kinds))))
        return cls([_Table(p) for p in bits], [_Table(p) for p in away], new, alphabets)

    def code_lengths(self, spans: list[str]) -> np.ndarray:
        """(spans x languages): bits a character."""
        if not spans:
            return np.zeros((0, len(LANGUAGES)))
        parts = [_units(s) for s in spans]
        size = np.array([len(x) + 1 for x in parts])
        u = np.concatenate([np.concatenate([[np.uint64(32)], x]) for x in parts])
        before = np.concatenate([[np.uint64(32)], u[:-1]])
        out = np.zeros((len(u), len(LANGUAGES)), np.float32)
        open_ = np.ones(out.shape, bool)
        for n in range(ORDER, -1, -1):
            got = self.bits[n](_hashes(u, n + 1))
            hit = got > 0
            out += np.where(open_, np.where(hit, got, self.away[n](_hashes(before, n))), 0)
            open_ &= ~hit
        out += np.where(open_, self.new[_classes(u)], 0)
        ends = np.cumsum(size)
        sums = np.concatenate([np.zeros((1, out.shape[1])), np.cumsum(out, axis=0, dtype=np.float64)])
        # the blank before a span isn't part of it
        return (sums[ends] - sums[ends - size + 1]) / np.maximum(size - 1, 1)[:, None]

    def calibrate(self, seed: int = 1) -> Trees:
        """Sets the limits: what only LIMIT_SHARE of random pieces of a language's symbols need less than."""
        rng = np.random.default_rng(seed)
        for j, a in enumerate(self.alphabets):
            letters = a[(_classes(a) < 5)]
            if len(letters):
                pieces = ["".join(map(chr, rng.choice(letters, 40))) for _ in range(300)]
                self.limit[j] = np.quantile(self.code_lengths(pieces)[:, j], LIMIT_SHARE)
        return self


def train(rows: list[tuple[str, str]]) -> Trees:
    """Trees of LANGUAGES from (language, text) rows; a language without rows codes nothing cheaply."""
    # a stray Latin word isn't part of a language with a script of its own
    rows = [(la, re.sub(r"[A-Za-z]+", " ", t) if la in ("zh", "ja", "ru") else t) for la, t in rows]
    best = Trees.fit(rows).code_lengths([t for _, t in rows]).argmin(1)
    kept = [r for r, b in zip(rows, best) if LANGUAGES[b] == r[0]]
    return Trees.fit(kept).calibrate()


def training_rows(docs: DataFrame, key: str = "doc_id") -> list[tuple[str, str]]:
    """At most TRAIN_DOCS rows a language: those with the least hash of their key, of texts with sentences."""
    from pyspark.sql.window import Window

    lang = F.lower(F.substring(F.trim("lang"), 1, 2))
    sentence = F.regexp_replace("text", r"(?s)```.*?```|<[^>]*>|\$[^$]*\$|[|=#*_~`]+", " ")
    ok = docs.select(key, lang.alias("lang"), sentence.alias("text")).filter(F.col("lang").isin(*LANGUAGES) & (F.length("text") > 150) & F.col("text").rlike(r"[.。]\s|。"))
    salt = F.pmod(F.xxhash64(key), F.lit(64))
    w = Window.partitionBy("lang", "salt").orderBy(F.xxhash64(key), key)
    few = ok.withColumn("salt", salt).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= TRAIN_DOCS // 64).select("lang", F.substring("text", 1, TRAIN_CHARS).alias("text"), key)
    return sorted((r[0], r[1]) for r in few.collect())


# --- spans

_STR = r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\''
_READ = {
    "hash": re.compile(r'("""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|' + _STR + r")|((?<![\w$\\])#[^\n]*)"),
    "slash": re.compile(r"(" + _STR + r"|`(?:[^`\\]|\\.)*`)|((?<!:)//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))"),
    # a key is read first and is no group; were it only passed over, its closing quote would open a string
    "json": re.compile(r'"(?:[^"\\\n]|\\.)*"\s*:|("(?:[^"\\\n]|\\.)*")|(?!)()'),
}
_YAML_VALUE = re.compile(r"^\s*(?:- +)*(?:[^\s#:\"'][^#:\n]*:\s+|- +)([^\s\"'#\[{|>&*!][^\n#]*)", re.M)
_SIGNS = (("go", re.compile(r"^package \w+\s*$", re.M)), ("java", re.compile(r"^\s*(?:public |import java|package [\w.]+;)", re.M)), ("c", re.compile(r"^\s*#\s*(?:include|define|ifndef)\b", re.M)), ("python", re.compile(r"^(?:def \w+\(|class \w+[(:]|import [\w.]+(?: as \w+)?[ \t]*\r?$|from [\w.]+ import|    def )", re.M)), ("javascript", re.compile(r"\b(?:const|let|var) \w+ =|=> ?\{|\bfunction\b|^exports\.|\"use strict\"", re.M)), ("shell", re.compile(r"\A#!|^\s*(?:fi|done|esac)\s*$", re.M)), ("yaml", re.compile(r"^[\w.-]+:[ \t]*\r?\n[ \t]+(?:-[ \t]|[\w.-]+:)", re.M)))
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_NOISE = re.compile(r"https?://\S+|\S*[/\\_=<>{}()\[\]@#$%^&|+~`]\S*|\S*\d\S*|\b\w*[a-z][A-Z]\w*\b|\S{30,}")
_CJK = re.compile("[぀-ヿ㐀-鿿々ー]")
_SQL = re.compile(r"(?i)^\s*(?:select\b.*\bfrom\b|insert into\b|update \w+ set\b|delete from\b|create (?:table|index|view)\b|alter table\b|drop table\b|with \w+ as \()", re.S)
_CODE = re.compile(r"[;{}]\s*$|^\s*(?:return|import|from|if|for|while|var|let|const|def|func|class|public|static)\b.*[({;:=]|\w\(.*\)\s*;?$|\w\s*(?:[-+*/]?=|==)\s*\w|^\s*(?:sudo|curl|wget|git|npm|pip|docker|make|cd|ls|rm|mysql|ssh)\s+-?\w")
_TAGS = re.compile(r"<[a-zA-Z/!][^<>]*>")


def written_in(text: str, stated: str | None) -> str:
    """The language the text is really written in: by its own signs, else as stated."""
    head = text.lstrip("﻿ \r\n\t")
    if head[:1] in "{[" and re.match(r'[{\[]\s*(?:"[^"\n]*"\s*:|[{\["\d\-]|[}\]])', head):
        return "json"
    signs = [k for k, rx in _SIGNS if rx.search(text)]
    if stated in signs:
        return stated
    if signs:
        return signs[0]
    return stated or "javascript"


def spans(text: str, lang: str) -> list[str]:
    kind = "json" if lang == "json" else "hash" if lang in ("python", "shell", "yaml") else "slash"
    out = []
    for m in _READ[kind].finditer(text):
        if m[1] is None and m[2] is None:
            continue
        if m[1] is not None:
            s = m[1]
            q = 3 if s[:3] in ('"""', "'''") else 1
            if lang == "yaml" and text[m.end() : m.end() + 1] == ":":
                continue
            s = s[q:-q]
            if "\\" in s:
                s = re.sub(r"\\u([0-9a-fA-F]{4})", lambda u: chr(int(u[1], 16)), s)
                s = re.sub(r"\\[nrt]", " ", s).replace('\\"', '"')
        else:
            s = re.sub(r"(?m)^\s*(?:/?\*+/?|//+|#+!?)|\*/\s*$", " ", m[2])
        out.append(s)
    if lang == "yaml":
        out += [m[1] for m in _YAML_VALUE.finditer(text)]
    return out


def running(span: str) -> str:
    """The running text of a span, without what isn't text; empty if there is too little."""
    t = _TAGS.sub(" ", span) if "<" in span else span
    if len(_CJK.findall(t)) >= CJK_CHARS:
        return t
    if _SQL.match(t) or _CODE.search(t.strip()):
        return ""
    t = _NOISE.sub(" ", t)
    w = _WORD.findall(t)
    if len(w) < WORDS or sum(len(x) > 1 for x in w) < WORDS or sum(x.isupper() and len(x) > 1 for x in w) > len(w) / 2:
        return ""
    return " ".join(w)


def read_files(df: DataFrame, rows: list[tuple[str, str]], key: str = "id", text: str = "text", language: str = "language", path: str = "file_path") -> DataFrame:
    """(key, nl_lang, n_spans, n_chars, share): languages in each row's text; undetermined spans have `und`. share: of the text's characters."""
    require(df, key, text, language, path)
    sent = df.sparkSession.sparkContext.broadcast(train(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = sent.value
        for b in batches:
            texts = b.column(1).to_pylist()
            of, got, size = [], [], []
            for i, (t, la, p) in enumerate(zip(texts, b.column(2).to_pylist(), b.column(3).to_pylist())):
                for s in spans(t, written_in(t, language_of(la, p))):
                    if r := running(s):
                        of.append(i), got.append(r), size.append(len(s))
            bits = trees.code_lengths(got)
            sums: dict[tuple[int, str], list[int]] = {}
            for i, n, x in zip(of, size, bits):
                k = int(x.argmin())
                lang = LANGUAGES[k] if x[k] <= trees.limit[k] else "und"
                q = sums.setdefault((i, lang), [0, 0])
                q[0] += 1
                q[1] += n
            keys = sorted(sums)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i for i, _ in keys], pa.int64())), pa.array([la for _, la in keys], pa.string()), pa.array([sums[k][0] for k in keys], pa.int64()), pa.array([sums[k][1] for k in keys], pa.int64()), pa.array([min(1.0, sums[k][1] / len(texts[k[0]])) for k in keys], pa.float64())], names=[key, "nl_lang", "n_spans", "n_chars", "share"])

    kind = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("nl_lang", T.StringType()), T.StructField("n_spans", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("share", T.DoubleType())])
    return spread(df.select(key, text, language, path).filter(F.length(text) > 0)).mapInArrow(run, kind)


def shares_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_files(table(spark, sf_dir, "code_input"), training_rows(table(spark, sf_dir, "documents"))).distinct()


def found_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares_query(spark, sf_dir).filter("nl_lang != 'und'").select("id", "nl_lang").distinct()
