"""Problem 10: text statistics of each document, and the documents that aren't natural prose.

Features are counted for all texts of an Arrow batch at once, in arrays over their characters (classes from a table, counts
between line borders from running sums, words by rolling hashes); what is learned from them is applied natively. There is no
shuffle. Null and empty texts have counts of 0 and null ratios.

Method: an ordered rule list, induced by incremental reduced-error pruning (grow a rule by FOIL gain on two thirds of
the examples, prune it on the rest, of several such splits keep the best rule, stop when pruned rules are right in less than nine of ten cases) on the lines of labelled
documents. The labelled documents are made by `labelled_documents` from the common words of the languages and invented
words, at most `TRAIN_DOCS` of them whatever the corpus. The learned thresholds become one SQL CASE expression that
gives each line a kind; a document of 100 characters or more is a case if more than half of its characters are in lines
that aren't prose, and has the kind most of these are of. Fenced code counts as neither.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.runtime import require, spread, table

TRAIN_DOCS = 6000
#: Characters that are worked on at once.
PART_CHARS = 500_000
KINDS = ("table", "list", "junk")
FEATURES = ("words", "common", "sents", "pipes", "tabs", "semis", "commas", "gaps", "tags", "marker", "awl", "symbols", "digits", "cjk", "cells", "odd", "b_lines", "b_wpl", "b_common", "b_sents", "b_rep", "b_long", "b_sep")
_BREAK = r"\r\n|[\r\n\u0085  \u000b\u000c]"
_FENCE = re.compile(r"(?:^|\n)[^\S\n]*```.*?(?:\n[^\S\n]*```[^\n]*|$)", re.S)
_MARK = re.compile(r"(?:[-*+•◦‣▪·–—][^\S\n]|\[[ xX]\]|\(?[0-9a-zA-Z]{1,3}[.)][^\S\n]|\d+(?:\.\d+)+[^\S\n])")
_TAGS = re.compile(r"(?i)</?(?:table|t[rdh]|tbody|thead)\b")
#: What is cut from the ends of a word before it is looked up.
_PUNCTUATION = ".,;:!?…\"'“”‘’«»()[]{}<>|/\\*_=#&~+-–—•◦·%$@^`。，、；：？！（）「」『』"
#: Characters that texts in a wrong encoding are full of.
_ODD = [*range(0x80, 0xA0), *range(0xA2, 0xA7), 0xA8, 0xA9, *range(0xAC, 0xB0), *range(0xB1, 0xB7), 0xB8, 0xB9, *range(0xBC, 0xBF), *map(ord, "ÃÂâ€�")]
#: Classes of characters, a bit each.
_NL, _WS, _CJK, _PIPE, _TAB, _SEMI, _COMMA, _SYMBOL, _DIGIT, _ODDITY, _STOP, _CLOSE, _PUNCT, _FULL = (1 << k for k in range(14))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(classes, mixed lower case) of each code point."""
    kinds = np.zeros(0x110000, np.uint16)
    lower = np.arange(0x110000, dtype=np.uint64)
    # planes without letters or signs of their own, and halves of pairs, have no class
    for c in chain(range(0xD800), range(0xE000, 0x32400), range(0xE0000, 0xE0200)):
        x = chr(c)
        if x.isspace():
            kinds[c] |= _WS
        elif not unicodedata.category(x).startswith(("L", "N")):
            kinds[c] |= _SYMBOL
        if x != (y := x.lower()) and len(y) == 1:
            lower[c] = ord(y)
    for chars, bit in (("\n\r\x85\u2028\u2029\x0b\x0c", _NL | _WS), ("|│", _PIPE), ("\t", _TAB), (";", _SEMI), (",", _COMMA), ("0123456789", _DIGIT), (".!?…", _STOP), ("\"'”»)]", _CLOSE), (_PUNCTUATION, _PUNCT), ("。！？", _FULL)):
        for x in chars:
            kinds[ord(x)] |= bit
    kinds[0x3040:0x3100] |= _CJK
    kinds[0x3400:0xA000] |= _CJK
    kinds[_ODD] |= _ODDITY
    with np.errstate(over="ignore"):
        mixed = (lower + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return kinds, mixed


_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 2**64)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (_BASE, _INVERSE))


def _running(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def _hashes(mixed: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each stretch of mixed characters that doesn't depend on its place."""
    up, down = _powers(1 << max(16, (len(mixed) + 1).bit_length()))
    with np.errstate(over="ignore"):
        total = np.zeros(len(mixed) + 1, np.uint64)
        np.cumsum(mixed * up[: len(mixed)], out=total[1:])
        return (total[end] - total[start]) * down[start]


def _hashes_of(words: list[str]) -> np.ndarray:
    mixed = _tables()[1]
    return np.array([_hashes(mixed[[ord(c) for c in w]], np.array([0]), np.array([len(w)]))[0] for w in words if w], np.uint64)


def text_features(texts: list[str | None], own: np.ndarray, cjk: re.Pattern) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines x FEATURES and chars, text of each line, characters of each text's lines in all).

    own: hashes of the common words; cjk: the common words of languages without spaces.
    """
    whole = np.zeros(len(texts))
    plain = []
    for i, t in enumerate(texts):
        t = (t or "").replace("\r\n", "\n")
        if "```" in t:
            whole[i] = sum(len(x.strip()) for x in re.split(_BREAK, t))
            t = _FENCE.sub("\n\n", t)
        plain.append(t)
    joined = "\n\n".join(plain) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, mixed = _tables()
    k = kinds[code]
    size = len(code)
    space, ends = (k & _WS) > 0, np.flatnonzero(k & _NL)
    starts = np.concatenate([[0], ends[:-1] + 1])
    text_at = np.cumsum([0] + [len(t) + 2 for t in plain[:-1]])
    full = _running(~space)
    some = full[ends] > full[starts]
    # a block ends at each blank line, and texts are parted by blank lines
    block = np.cumsum(~some)[some]
    starts, ends = starts[some], ends[some]
    of = np.searchsorted(text_at, starts, "right") - 1
    n = len(starts)
    if not n:
        return np.zeros((0, len(FEATURES) + 1), np.float32), of, np.maximum(whole, 1)
    block = np.cumsum(np.concatenate([[False], (block[1:] != block[:-1]) | (of[1:] != of[:-1])]))
    count = lambda mask: (p := _running(mask))[ends] - p[starts]
    bit = lambda b: count((k & b) > 0)
    at = np.arange(size)
    solid = np.flatnonzero(~space)
    first, last = solid[full[starts]], solid[full[ends] - 1]
    chars, filled = last - first + 1, full[ends] - full[starts]
    n_cjk = bit(_CJK)
    is_cjk = n_cjk * 4 > filled

    # words, without the punctuation at their ends
    before = np.concatenate([[True], space[:-1]])
    w0 = np.flatnonzero(~space & before)
    w1 = np.flatnonzero(space & ~before)
    line_of = np.searchsorted(starts, w0, "right") - 1
    inner = (k & _PUNCT) == 0
    head = np.minimum.accumulate(np.where(inner, at, size)[::-1])[::-1]
    tail = np.maximum.accumulate(np.where(inner, at, -1))
    a, z = head[w0], tail[w1 - 1] + 1
    kept = (a < w1) & (z > a)
    h = _hashes(mixed[code], np.where(kept, a, 0), np.where(kept, z, 0))
    n_words = np.bincount(line_of, minlength=n)
    n_kept = np.bincount(line_of, kept, minlength=n)
    n_common = np.bincount(line_of, kept & np.isin(h, own), minlength=n)
    common = n_common / np.maximum(n_words, 1)
    for i in np.flatnonzero(is_cjk).tolist():
        common[i] = len(cjk.findall(joined, starts[i], ends[i])) / max(1, n_cjk[i])

    # ends of sentences: marks, then closing signs, then white space
    open_ = np.maximum.accumulate(np.where((k & _CLOSE) == 0, at, -1))
    low = code == 95
    mark = ((k & _STOP) > 0) | (low & np.concatenate([[False], low[:-1]]))
    j = open_[w1 - 1]
    done = np.bincount(line_of, (j >= w0) & mark[np.maximum(j, 0)], minlength=n) + bit(_FULL)

    blank = code == 32
    solid_at = np.maximum.accumulate(np.where(~blank, at, -1))
    follow = np.concatenate([~space[1:], [False]])
    wide = blank & np.concatenate([[False], blank[:-1]]) & follow & (solid_at >= 0) & ~space[np.maximum(solid_at, 0)]
    tags = np.zeros(n)
    if "<" in joined:
        for m in _TAGS.finditer(joined):
            tags[np.searchsorted(starts, m.start(), "right") - 1] += 1
    marker = np.fromiter((_MARK.match(joined, i) is not None for i in first.tolist()), bool, n)
    comma = ((k & _COMMA) > 0) & np.concatenate([~blank[1:], [True]])
    f = dict(
        words=np.where(is_cjk, n_cjk / 2, n_words), common=common, sents=done, pipes=bit(_PIPE), tabs=bit(_TAB), semis=bit(_SEMI), commas=count(comma), gaps=count(wide), tags=tags, marker=marker,
        awl=filled / np.maximum(n_words, 1), symbols=bit(_SYMBOL) / filled, digits=bit(_DIGIT) / filled, cjk=is_cjk, cells=n_kept / np.maximum(n_words, 1), odd=bit(_ODDITY) / filled)

    # what a block has as a whole
    lines_in = np.bincount(block)
    total = lambda x: np.bincount(block, x)
    wb = block[line_of]
    order = np.lexsort((h, wb))
    hs, bs = np.where(kept, h, 0)[order], wb[order]
    new = np.concatenate([[True], (hs[1:] != hs[:-1]) | (bs[1:] != bs[:-1])])
    different = np.bincount(bs, new, minlength=len(lines_in))
    longest = np.zeros(len(lines_in))
    np.maximum.at(longest, block, f["words"])
    apart = np.maximum.reduce([f["pipes"], f["tabs"], f["semis"], f["commas"], f["gaps"], f["tags"]]) > 0
    g = dict(b_lines=lines_in, b_wpl=total(f["words"]) / lines_in, b_common=total(common * chars) / total(chars), b_sents=total(done) / lines_in, b_rep=different / np.maximum(np.bincount(wb, minlength=len(lines_in)), 1), b_long=longest, b_sep=total(apart) / lines_in)
    whole = np.where(whole > 0, whole, np.bincount(of, chars, minlength=len(texts)))
    return np.stack([*(f[x] if x in f else g[x][block] for x in FEATURES), chars], axis=1).astype(np.float32), of, np.maximum(whole, 1)


def line_features(df: DataFrame, common: dict[str, list[str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, lines, whole) of each row: lines is an array of structs of FEATURES and chars, whole the characters of all lines."""
    own, cjk = _vocabulary(common)
    words, names = _hashes_of(own), (*FEATURES, "chars")
    kind = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("n_chars", T.LongType()), T.StructField("lines", T.ArrayType(T.StructType([T.StructField(x, T.FloatType()) for x in names]))), T.StructField("whole", T.DoubleType())])

    def see(texts: list[str | None], own_cjk: re.Pattern) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, of, whole = text_features(texts, words, own_cjk)
        return x, np.bincount(of, minlength=len(texts)), whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_cjk = re.compile(cjk)
        for b in batches:
            texts = b.column(1).to_pylist()
            held = np.cumsum([len(t or "") for t in texts])
            # arrays over about PART_CHARS characters stay in the processor's cache; a text is never divided
            parts = np.flatnonzero(np.diff(held // PART_CHARS, prepend=-1))
            got = [see(texts[i:j], own_cjk) for i, j in zip(parts, [*parts[1:], len(texts)])]
            x = np.concatenate([g[0] for g in got]) if got else np.zeros((0, len(names)), np.float32)
            offsets = np.concatenate([np.zeros(1, np.int32), np.cumsum(np.concatenate([g[1] for g in got]), dtype=np.int32)]) if got else np.zeros(1, np.int32)
            rows = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in x.T], names=list(names))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t or "") for t in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), rows), pa.array(np.concatenate([g[2] for g in got]) if got else [], pa.float64())], names=[key, "n_chars", "lines", "whole"])

    return spread(df.select(key, text)).mapInArrow(run, kind)


# --- labelled documents


def labelled_documents(common: dict[str, list[str]], n: int = TRAIN_DOCS, seed: int = 7) -> list[tuple[str, str]]:
    """(text, kind) of n made documents, each of one kind: prose, list, table or junk."""
    r = random.Random(seed)
    heads = {"ru": "бвгджзклмнпрстфхц", "zh": "", "ja": ""}
    vowels = {"ru": "аеиоуыя"}

    stock: list[str] = []

    def made(lang: str) -> str:
        # a document draws on a stock of its own, so words come again
        if stock and r.random() < 0.9:
            return r.choice(stock)
        stock.append(w := invented(lang))
        return w

    def invented(lang: str) -> str:
        if lang in ("zh", "ja"):
            return "".join(chr(r.randint(0x4E00, 0x8FFF)) for _ in range(r.randint(1, 3))) + ("".join(chr(r.randint(0x3042, 0x3093)) for _ in range(r.randint(0, 2))) if lang == "ja" else "")
        h, v = heads.get(lang, "bcdfghklmnprstvz"), vowels.get(lang, "aeiou")
        return "".join(r.choice(h) + r.choice(v) + (r.choice(h) if r.random() < 0.4 else "") for _ in range(r.randint(1, 4)))

    style = {"small": 0.0, "most": 3}

    def phrase(lang: str) -> str:
        k = r.randint(1, style["most"])
        if lang in ("zh", "ja"):
            return "".join(made(lang) for _ in range(k)) if r.random() < 0.7 else made(lang) + r.choice(common[lang]) + made(lang)
        w = [made(lang) for _ in range(k)]
        if r.random() < style["small"]:
            w.insert(1, r.choice(common[lang]))
        if r.random() < 0.15:
            w.insert(0, str(r.randint(1, 99)))
        if r.random() < 0.3:
            w[0] = w[0].capitalize()
        return (", " if r.random() < 0.1 else " ").join(w)

    def sentence(lang: str) -> str:
        if lang in ("zh", "ja"):
            return "".join(r.choice(common[lang]) if r.random() < 0.3 else made(lang) for _ in range(r.randint(6, 14))) + ("，" + "".join(made(lang) for _ in range(4)) if r.random() < 0.3 else "") + "。"
        rate = r.uniform(0.08, 0.5)
        w = [r.choice(common[lang]) if r.random() < rate else made(lang) for _ in range(r.randint(7, 18))]
        if r.random() < 0.4:
            w[len(w) // 2] += ","
        if r.random() < 0.2:
            w[2] = str(r.randint(1, 2000))
        return " ".join(w).capitalize() + r.choice("....!?")

    def prose(lang: str) -> str:
        sep = "" if lang in ("zh", "ja") else " "
        paras = [sep.join(sentence(lang) for _ in range(r.randint(2, 7))) for _ in range(r.randint(1, 4))]
        how = r.random()
        if how < 0.12:
            paras = ["".join(c for c in p.lower() if c.isalnum() or c == " ") for p in paras]
        elif how < 0.24 and sep:
            import textwrap

            paras = [textwrap.fill(p, r.randint(35, 100)) for p in paras]
        elif how < 0.34:
            paras = [f"{r.choice(['USER', 'Q', 'A', 'ASSISTANT', '-', '—'])}{': ' if i % 2 else ': '}{p}" for i, p in enumerate(paras)]
        elif how < 0.42 and sep:
            paras = [p.replace(" ", r.choice(["  ", " ", "　"])) for p in paras]
        elif how < 0.5:
            paras = [p.replace(".", r.choice(["...", "…", "__", "!!"])).replace("。", r.choice(["…", "。"])) for p in paras]
        elif how < 0.58:
            paras = ["# " + phrase(lang), *paras]
        return r.choice(["\n\n", "\n\n", "\n"]).join(paras)

    def listing(lang: str) -> str:
        k, how = r.randint(8, 40), r.randint(0, 9)
        mark = {0: lambda i: "- ", 1: lambda i: f"{i + 1}. ", 2: lambda i: "* ", 3: lambda i: f"({chr(97 + i % 26)}) ", 4: lambda i: r.choice(["[x] ", "[ ] "]), 5: lambda i: r.choice(["• ", "  ◦ ", "  – "]), 6: lambda i: f"{i // 5 + 1}.{i % 5 + 1} "}.get(how, lambda i: "")
        tail = {6: lambda: " " + "." * r.randint(3, 30) + f" {r.randint(1, 99)}", 7: lambda: ": " + phrase(lang)}.get(how, lambda: "")
        rows = [mark(i) + phrase(lang) + (" " + phrase(lang) if how in (8, 9) and r.random() < 0.6 else "") + tail() for i in range(k)]
        return "\n".join(([phrase(lang).upper() + ":"] if r.random() < 0.4 else []) + rows)

    def cells(lang: str) -> str:
        rows, cols, how = r.randint(4, 25), r.randint(3, 8), r.randint(0, 5)
        cell = lambda: r.choice([phrase(lang), "", "n/a", str(r.randint(1, 9999)), f"{r.uniform(1, 500):.2f}", f"{r.randint(1, 99)}%"])
        t = [[phrase(lang) if i == 0 or j == 0 else cell() for j in range(cols)] for i in range(rows)]
        if how == 0:
            return "\n".join(f"| {' | '.join(x)} |" for x in [t[0], ["---"] * cols, *t[1:]])
        if how == 1:
            return "<table>\n" + "\n".join("<tr>" + "".join(f"<td>{c}</td>" for c in x) + "</tr>" for x in t) + "\n</table>"
        if how == 2:
            return "\n".join("".join(f"{c[:13]:<16}" for c in x).rstrip() for x in t)
        if how == 3:
            bar = "+" + "+".join("-" * 16 for _ in range(cols)) + "+"
            return "\n".join(y for x in t for y in (bar, "|" + "|".join(f" {c[:14]:<15}" for c in x) + "|")) + "\n" + bar
        return "\n".join((("\t", ";", ",")[r.randint(0, 2) if how > 4 else 2]).join(c.replace(",", "") for c in x) for x in t) if how == 5 else "\n".join(r.choice("\t") .join(x) for x in t) if r.random() < 0.4 else "\n".join(";".join(x) for x in t)

    def junk(lang: str) -> str:
        how, k = r.choice((0, 1, 1, 2, 3, 4, 5, 6, 6, 7, 8, 8, 9, 10, 11, 11, 11)), r.randint(25, 120)
        letters = "abcdefghijklmnopqrstuvwxyz"
        b64 = letters + letters.upper() + "0123456789+/"
        if how == 0:
            return "".join(r.choice(b64) for _ in range(k * 8))
        if how == 1:
            return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 16))) for _ in range(k))
        if how == 2:
            return "".join(chr(r.randint(33, 126)) if r.random() < 0.85 else " " for _ in range(k * 6))
        if how == 3:
            return " ".join(str(r.randint(1, 10 ** r.randint(1, 9))) for _ in range(k))
        if how in (4, 5):
            return r.choice([" » ", " › ", " / ", " | ", " · ", " > "]).join(phrase(lang) for _ in range(k // 2))
        if how in (6, 7):
            one = phrase if lang in ("zh", "ja") else made
            return " ".join(one(lang) if r.random() < 0.95 else r.choice(common[lang]) for _ in range(k))
        if how == 8:
            return "\n".join(r.choice("_=#&.~*-+%!?$") * r.randint(8, 70) for _ in range(r.randint(5, 20)))
        if how == 9:
            return (made(lang) + r.choice([" ", "!!! ", ", ", "... ", ". ", "; "])) * k
        if how == 10:
            return "\n".join(" ".join(f"{r.randint(0, 255):02x}" for _ in range(16)) for _ in range(k // 6))
        return "".join(r.choice("¼€�ÃÂ¤â¡\xad") if r.random() < rate else c for rate in [r.uniform(0.25, 0.6)] for c in prose(lang))

    out = []
    langs = sorted(common)
    for i in range(n):
        lang = "en" if r.random() < 0.25 and "en" in common else r.choice(langs)
        kind = ("prose", "prose", "prose", "list", "table", "junk")[i % 6]
        style |= {"small": r.choice((0.0, 0.0, 0.1, 0.3)), "most": r.choice((1, 2, 3, 4))}
        stock[:] = [invented(lang) for _ in range(r.choice([8, 20, 60, 150, 400]))]
        out.append(({"prose": prose, "list": listing, "table": cells, "junk": junk}[kind](lang), kind))
    return out


# --- incremental reduced-error pruning

Rule = list[tuple[int, str, float]]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    m = np.ones(len(x), bool)
    for f, op, t in rule:
        m &= x[:, f] <= t if op == "<=" else x[:, f] >= t
    return m


def _grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, cuts: list[np.ndarray], most: int = 7) -> Rule:
    rule: Rule = []
    on = np.ones(len(x), bool)
    while len(rule) < most:
        xs, ys, ws = x[on], y[on], w[on]
        p, n = ws[ys].sum(), ws[~ys].sum()
        if n < 1e-9 or p < 1e-9:
            break
        base, best, pick = np.log2(p / (p + n)), 1e-9, None
        for f, cut in enumerate(cuts):
            if not len(cut):
                continue
            pos, neg = np.histogram(xs[ys, f], [-np.inf, *cut, np.inf], weights=ws[ys])[0], np.histogram(xs[~ys, f], [-np.inf, *cut, np.inf], weights=ws[~ys])[0]
            for op, pp, nn in (("<=", pos.cumsum()[:-1], neg.cumsum()[:-1]), (">=", p - pos.cumsum()[:-1], n - neg.cumsum()[:-1])):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - base), -1)
                if (k := int(np.argmax(gain))) is not None and gain[k] > best:
                    best, pick = gain[k], (f, op, float(cut[k]))
        if pick is None:
            break
        rule.append(pick)
        on &= _covers([pick], x)
    return rule


def induce(x: np.ndarray, kinds: list[str], weights: np.ndarray, order: tuple[str, ...] = KINDS, seed: int = 3, most_rules: int = 14, splits: int = 6) -> list[tuple[Rule, str]]:
    """An ordered rule list; what no rule covers is prose. Cuts lie between neighbouring quantiles, so no example sits on one."""
    rng = np.random.default_rng(seed)
    cuts = []
    for f in range(x.shape[1]):
        u = np.unique(np.quantile(x[:, f], np.linspace(0, 1, 81), method="nearest"))
        cuts.append((u[1:] + u[:-1]) / 2)
    kinds_ = np.array(kinds)
    live = np.ones(len(x), bool)
    out: list[tuple[Rule, str]] = []
    for kind in order:
        y = kinds_ == kind
        for _ in range(most_rules):
            if weights[live & y].sum() < 0.003 * weights[y].sum():
                break
            best, top = None, 0.0
            for _ in range(splits):
                g = live & (rng.random(len(x)) < 2 / 3)
                p = live & ~g
                rule = _grow(x[g], y[g], weights[g], cuts)

                def score(r: Rule) -> tuple[float, float]:
                    c = _covers(r, x) & p
                    good, bad = weights[c & y].sum(), weights[c & ~y].sum()
                    return (good - bad) / max(good + bad, 1e-9), good - 5 * bad

                while len(rule) > 1 and score(rule[:-1])[0] >= score(rule)[0]:
                    rule = rule[:-1]
                if rule and score(rule)[0] >= 0.8 and score(rule)[1] > top:
                    best, top = rule, score(rule)[1]
            if best is None:
                break
            out.append((best, kind))
            live &= ~_covers(best, x)
    return out


def as_case(rules: list[tuple[Rule, str]], alias: str = "x") -> str:
    """The rule list as a SQL expression over a struct of FEATURES."""
    if not rules:
        return "'prose'"
    return "CASE " + " ".join("WHEN " + " AND ".join(f"{alias}.{FEATURES[f]} {op} {t!r}" for f, op, t in rule) + f" THEN '{kind}'" for rule, kind in rules) + " ELSE 'prose' END"


@lru_cache(maxsize=4)
def _learned(words: tuple[tuple[str, tuple[str, ...]], ...], n: int) -> str:
    common = {k: list(v) for k, v in words}
    docs = labelled_documents(common, n)
    own, cjk = _vocabulary(common)
    x, of, _ = text_features([t for t, _ in docs], _hashes_of(own), re.compile(cjk))
    # each document has the weight 1, shared by its lines
    w = 1.0 / np.bincount(of, minlength=len(docs))[of]
    return as_case(induce(x[:, : len(FEATURES)].astype(float), [docs[i][1] for i in of], w))


def _vocabulary(common: dict[str, list[str]]) -> tuple[list[str], str]:
    own = sorted({w for k, v in common.items() if k not in ("zh", "ja") for w in v})
    cjk = sorted({w for k, v in common.items() if k in ("zh", "ja") for w in v}, key=lambda w: (-len(w), w))
    return own or ["the"], "|".join(map(re.escape, cjk)) or "的"


def common_words(spark: SparkSession, sf_dir: str, bound: int = 20_000) -> dict[str, list[str]]:
    """The languages' frequent words; a table of settings, more than `bound` rows are an error."""
    rows = table(spark, sf_dir, "common_words").filter("lang IS NOT NULL AND word IS NOT NULL").select("lang", "word").distinct().limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"common_words has more than {bound} rows")
    out: dict[str, list[str]] = {}
    for lang, w in sorted(map(tuple, rows)):
        out.setdefault(lang, []).append(w)
    return out


def rule_list(common: dict[str, list[str]], n: int = TRAIN_DOCS) -> str:
    return _learned(tuple((k, tuple(v)) for k, v in sorted(common.items())), n)


def classify(df: DataFrame, common: dict[str, list[str]], key: str = "doc_id", text: str = "text", least: int = 100) -> DataFrame:
    """(key, n_chars, list_share, table_share, junk_share, kind) of each row; kind is null for prose and for texts under `least` characters."""
    require(df, key, text)
    case = rule_list(common)
    # what isn't in a line of its own (fenced code) counts in the whole, not in a kind
    kinds = F.expr(f"transform(lines, x -> struct({case} AS kind, CAST(x.chars AS DOUBLE) AS chars))")
    base = line_features(df, common, key, text).select(key, "n_chars", "whole", kinds.alias("_k"))
    of = lambda k: F.aggregate(F.filter("_k", lambda x: x["kind"] == k), F.lit(0.0), lambda a, x: a + x["chars"])
    got = base.select(key, "n_chars", *[(of(k) / F.col("whole")).alias(f"{k}_share") for k in KINDS])
    t, l, j = (F.col(f"{k}_share") for k in KINDS)
    kind = F.when((F.col("n_chars") < least) | (t + l + j <= 0.5), None).when((t >= l) & (t >= j), "table").when(l >= j, "list").otherwise("junk")
    return got.withColumn("kind", kind)


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def statistics(df: DataFrame, common: dict[str, list[str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics of each row, all native. Words are runs without white space; shares of nothing are null."""
    require(df, key, text)
    own, cjk = _vocabulary(common)
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, r"\s+"), lambda w: F.length(w) > 0)
    lines = F.filter(F.split(t, r"\r\n|\r|\n"), lambda x: F.length(F.trim(x)) > 0)
    n, m = F.col("n_words"), F.col("n_lines")
    nul = lambda a, b: F.when(b > 0, a / b)
    base = df.select(key, t.alias("_t"), words.alias("_w"), lines.alias("_l"))
    base = base.select(key, "_t", "_w", "_l", F.length("_t").alias("n_chars"), F.size("_w").alias("n_words"), F.size("_l").alias("n_lines"))
    return base.select(
        key, "n_chars", "n_words", "n_lines",
        nul(F.aggregate("_w", F.lit(0).cast("bigint"), lambda a, w: a + F.length(w)), n).alias("mean_word_length"),
        nul(_count(F.col("_t"), r"[^\p{L}\p{N}\s]"), F.col("n_chars")).alias("symbol_ratio"),
        nul(_count(F.col("_t"), r"[0-9]"), F.col("n_chars")).alias("digit_ratio"),
        nul(F.size(F.filter("_l", lambda x: F.rtrim(x).rlike(r"[.!?。！？…][\"'”»)]*$"))), m).alias("punctuated_line_share"),
        nul(F.size(F.filter("_w", lambda w: F.btrim(F.lower(w), F.lit(_PUNCTUATION)).isin(own))), n).alias("common_word_share"),
        nul(F.size(F.array_distinct("_w")), n).alias("distinct_word_share"),
        nul(F.size(F.filter("_l", lambda x: x.rlike(r"^\s*[-*•]\s"))), m).alias("bullet_line_share"))


def found_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = classify(table(spark, sf_dir, "documents"), common_words(spark, sf_dir))
    return got.filter(F.col("kind").isNotNull()).select("doc_id", "kind").distinct()


def statistics_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics(table(spark, sf_dir, "documents"), common_words(spark, sf_dir))
