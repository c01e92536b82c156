"""Problem 5: credentials in source and configuration files, found with their place and blanked out.

Method: quoted strings (adjacent or concatenated ones joined) and long bare tokens are taken from each file; each has its
Shannon entropy in the alphabet it is written in held against a threshold that falls with its length, as a short string
can't reach the entropy of its alphabet. What stands above is a credential if it is long and of both cases and digits, or if a name, a scheme or a known form
says so: a secret-like name before it, a user-info part of a URL, an authorisation header, an option of a command, a login in a comment, a vendor's token form, a PEM
block of a private key. Hashes, identifiers, names of fields, stand-ins and references to the environment or a vault are
excluded. Pass phrases of words count under a name of a password.

Redaction replaces the characters of each credential by `X`, one for one (quotes, escapes and line breaks stay), so the file
keeps its lines, its lengths and its syntax. Nulls and empty texts have no credentials. Whole texts are read.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.runtime import require, spread, table

#: Forms of vendors' tokens.
FORMS = (r"AKIA[0-9A-Z]{16}", r"ASIA[0-9A-Z]{16}", r"gh[pousr]_[A-Za-z0-9]{30,}", r"github_pat_\w{40,}", r"glpat-[\w-]{18,}", r"xox[abeoprs]-[\w-]{10,}", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}", r"sk-[\w-]{20,}", r"AIza[\w-]{30,}", r"npm_[A-Za-z0-9]{30,}", r"pypi-[\w-]{20,}", r"SG\.[\w-]{16,}\.[\w-]{16,}", r"eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{10,}", r"hf_[A-Za-z0-9]{30,}", r"dop_v1_[a-f0-9]{60,}", r"ya29\.[\w-]{20,}")
#: Last words of names that hold secrets, alone or in pairs; and words that follow such names without changing them.
ALONE = frozenset("password passwd pwd pw pass passphrase passcode secret token apikey auth credential credentials authtoken secretkey accesstoken accesskey privatekey clientsecret".split())
PAIRS = frozenset("api key|secret key|access key|signing key|private key|auth key|service key|master key|encryption key|account key|shared key|root pass|admin pass|webhook key|license key".split("|"))
PASSWORDS = frozenset("password passwd pwd pw pass passphrase passcode secret auth token key apikey credential credentials".split())
SUFFIXES = frozenset("dev prod ci main old new test stage staging local default value str string v str1 tmp backup current x b64 base64 encoded enc hex".split())

_FORM = re.compile(r"(?<![A-Za-z0-9_-])(?:" + "|".join(FORMS) + r")(?![A-Za-z0-9])")
_STRING = re.compile(r'"((?:[^"\\\n]|\\.)*)"|\'((?:[^\'\\\n]|\\.)*)\'|`((?:[^`\\\n]|\\.)*)`')
_JOINT = re.compile(r"\s*(?:\+|\.\.?|\\)?\s*")
_NAME = re.compile(r"""([A-Za-z_][\w.\-]*)["'`]?\]?\s*(?::\s*[\w<>\[\]&*|]+\s*)?(?:=>|:=|=|:|,|\()\s*(?:(?:new\s+)?\w*\(|\{\s*value\s*:\s*|[brufBRUF]{1,2}|&)*$""")
_DEFINE = re.compile(r"#\s*define\s+([A-Za-z_]\w*)\s+$")
_BEFORE = re.compile(r"""([A-Za-z_][\w.\-]*)["'`]?\s*(?::\s*[\w<>\[\]&*|]+\s*|\[\d*\]\s*)?(?:=>|:=|=|:|\()\s*$""")
_INNER = re.compile(r"(?:^|(?<=[;&?,\s\"'{(-]))([A-Za-z][\w.\-]*(?: [\w.\-]+)?)\s*(?:=|:)\s*[\"']?([^\s;&\"',<>]+)")
_SCHEME = re.compile(r"(?i)\b(bearer|basic|token)\s+([\w+/=.~-]{8,})")
_URL = re.compile(r"[A-Za-z][\w+.-]*://([^\s/:@\"'`]*):([^\s@/\"'`]+)@")
_COMMENT = re.compile(r"^\s*(?:#(?!\s*(?:define|include))|//|\*|/\*|--|;)|(?<=\s)(?:#|//)\s")
_BARE = re.compile(r"""(?:^|[\s;{,(])(?:export\s+)?["']?([A-Za-z_][\w.\- ]*?)["']?\s*[:=]\s*([^\s"'`;,(){}\[\]]+)""")
_FLAG = re.compile(r"(?:^|\s)--?([A-Za-z][\w-]*)[= ]([^\s\"'`-][^\s\"'`]*)")
_OPTION = re.compile(r"""(?:^|\s)(?:-p|--pass(?:word|wd)?[= ]|-u\s+[\w.@-]+:)["']?([^\s"']{4,})""")
_LOGIN = re.compile(r"""(?i)\b(?:log[- ]?in|sign[- ]?in|user(?:name)?|account)\b[ :=]+[\w.@-]+\s+/\s+["']?([^\s"']{4,})""")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_BODY = re.compile(r"[A-Za-z0-9+/=]{16,}")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_UUID = re.compile(r"^\{?[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\}?$")
#: What stands in for a secret, and what refers to one.
_STAND_IN = re.compile(r"(?i)^(?:change[_-]?(?:me|it|this)|.*(?:example|sample|placeholder|redacted|insert|replace|dummy|fixme|todo|your[_-]|_here|-here|not[_-]?real|fake).*|(.)\1*|(?:x|\*|0|\.|-|_)+|tbd|none|null|nil|true|false|undefined|unset|empty|n/a|test(?:ing)?\d*|foo|bar|baz|secret|password|passw0rd|token|key|abc123|12345\w*|abcdef\w*|hunter2|my[_-]?(?:password|secret|token|key))$")
_REFERENCE = re.compile(r"\$\{|\$\(|^\$[A-Za-z_]|\{\{|\}\}|<%|^%[sdvq]|%\(|^\{\w*\}$|#\{|\b(?:env|environ|getenv|vault|ssm|kms|secretsmanager|keyring|config)\b[.:(\[/]|^(?:arn|vault|env|file|ref|secret|op|ssm|gcp|aws-sm)://?|^@\w|^<.*>$|^\[.*\]$|^/[\w./-]+$|^\.{1,2}/")
_SNAKE = re.compile(r"^(?:[a-z]+|[A-Z]+|[A-Z][a-z]+)(?:[_.\-/ ](?:[a-z]+|[A-Z]+|[A-Z][a-z]+)){0,2}$|^[a-z]+(?:_[a-z]+)*$|^[A-Z]+(?:_[A-Z]+)*$")
_VARIABLE = re.compile(r"^[a-z]+(?:_[a-z]+)*\d{0,3}$|^[a-z]+(?:[A-Z][a-z]+)*\d{0,3}$|.*[(\[].*")
_CAMEL = re.compile(r"^[A-Z]?[a-z]+(?:[A-Z][a-z]+)*\d?$")
_PHRASE = re.compile(r"^[a-z]{2,}(?:[-_. ][a-z]{2,}){3,}$")
#: Words of names and calls whose values are random by nature and give no access.
_PUBLIC = frozenset("hash digest checksum sha md5 sum commit revision rev etag fingerprint integrity uuid guid id ids nonce iv salt signature sig public table data image icon font cert certificate seed crc".split())
_IDENTIFIER = re.compile(r"[A-Za-z_.-]+\d{0,3}")
_ONE_WORD = re.compile(r"[\w+/=.~!@#$%^&*-]+")
_ENDED = re.compile(r"[\"'`][\s;,)\]}]*(?:(?:#|//).*)?")
_HASHED = re.compile(r"^(?:sha\d{1,3}[-:]|md5:|\$2[aby]\$|\$argon|\$[156]\$|\{ssha\}|data:)", re.I)


def entropy(s: str) -> float:
    """Shannon entropy in bits a character."""
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in Counter(s).values()) if n else 0.0


def alphabet(s: str) -> int:
    """Size of the smallest usual alphabet that s is written in."""
    if re.fullmatch(r"\d+", s):
        return 10
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        return 16
    size = 26 * (any(c.islower() for c in s) + any(c.isupper() for c in s)) + 10 * any(c.isdigit() for c in s)
    return max(2, size + 16 * any(not c.isalnum() for c in s))


def random_like(s: str) -> bool:
    """Whether s isn't empty and is above the threshold for its alphabet and length: a random string of n characters has about log2(min(n, alphabet)) bits."""
    return bool(s) and entropy(s) >= 0.72 * math.log2(max(2, min(len(s), alphabet(s))))


def secret_name(name: str) -> str | None:
    """`password` or `key` if a name says that it holds a secret."""
    w = [x.lower() for x in _WORDS.findall(name)]
    while w and (w[-1].isdigit() or w[-1] in SUFFIXES):
        w.pop()
    if not w:
        return None
    two = " ".join(w[-2:])
    if two in PAIRS:
        return "key"
    if w[-1] in ALONE:
        return "password" if w[-1] in PASSWORDS else "key"
    if w[-1] == "key" and len(w) == 1:
        return None
    return None


def is_credential(value: str, named: bool) -> bool:
    """Whether a literal gives access, when its name (or place) says that it should."""
    v = value.strip()
    if len(v) < 6 or _REFERENCE.search(v) or _STAND_IN.match(v) or _HASHED.match(v):
        return False
    if _PHRASE.match(v):
        # a phrase's alphabet is its words, so it is their number that tells
        return named and len(set(re.split(r"[-_. ]", v))) > 1
    if any(c.isspace() for c in v) or _SNAKE.match(v) or _CAMEL.match(v) or _UUID.match(v):
        return False
    if re.fullmatch(r"[\d.,:/\-+eE]+", v) or re.fullmatch(r"[^A-Za-z0-9]+", v) or "://" in v or re.fullmatch(r"[\w.-]+\.(?:py|js|go|c|h|java|json|ya?ml|sh|txt|md|pem|crt|com|org|net|io|internal)", v):
        return False
    if not v.isascii() or any(c in v for c in "(){};") and re.search(r"\w\(|\);|\{\w", v):
        return False
    return random_like(v)


def nominated(value: str) -> bool:
    """Whether a literal is a credential by entropy alone: random text of 16 to 80 characters in both cases and digits, no hash, identifier or name.

    Shorter ones can't be told from codes and names of types without a name; longer ones without a known form are embedded data.
    """
    if not 16 <= len(value) <= 80 or not (any(c.isdigit() for c in value) and any(c.isupper() for c in value) and any(c.islower() for c in value)):
        return False
    return not _IDENTIFIER.fullmatch(value) and bool(_ONE_WORD.fullmatch(value)) and is_credential(value, True) and entropy(value) >= 0.8 * math.log2(min(len(value), alphabet(value)))


def _literals(line: str) -> Iterator[tuple[str, list[tuple[int, int]], int]]:
    """(joined value, spans of its parts, start) of the strings of a line; neighbours that are concatenated are one."""
    cur, spans, start, end = None, [], 0, 0
    for m in _STRING.finditer(line):
        g = m.lastindex or 1
        body, span = m[g] or "", (m.start(g), m.end(g))
        if cur is not None and _JOINT.fullmatch(line, end, m.start()) and (m.start() > end or line[m.start()] == line[end - 1]):
            cur, end = cur + body, m.end()
            spans.append(span)
            continue
        if cur is not None:
            yield cur, spans, start
        cur, spans, start, end = body, [span], m.start(), m.end()
    if cur is not None:
        yield cur, spans, start


def _cut(spans: list[tuple[int, int]], a: int, b: int) -> list[tuple[int, int]]:
    """The part [a, b) of the joined value as spans of the line."""
    out, at = [], 0
    for s, e in spans:
        lo, hi = max(a - at, 0), min(b - at, e - s)
        if lo < hi:
            out.append((s + lo, s + hi))
        at += e - s
    return out


def _basic(v: str) -> bool:
    try:
        t = base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode("utf-8")
    except (binascii.Error, ValueError):
        return False
    user, colon, word = t.partition(":")
    return bool(colon) and len(word) >= 4 and random_like(word) and not _STAND_IN.match(word) and not _REFERENCE.search(word)


def line_spans(line: str, before: str = "", config: bool = False) -> list[tuple[int, int]]:
    """Spans of the credentials of one line. before: the line above; config: names and values needn't be quoted."""
    out: list[tuple[int, int]] = []
    out += [m.span() for m in _FORM.finditer(line) if not _STAND_IN.match(m[0]) and random_like(m[0])]
    if "://" in line:
        out += [m.span(2) for m in _URL.finditer(line) if len(m[2]) >= 4 and random_like(m[2]) and not _STAND_IN.match(m[2]) and not _REFERENCE.search(m[2]) and m[2].lower() not in ("pass", "passwd", "pwd", "password", "secret") and not re.fullmatch(r"[%{<\[$].*", m[2])]
    for m in _SCHEME.finditer(line):
        kind, v = m[1].lower(), m[2]
        if _basic(v) if kind == "basic" else is_credential(v, True) and (kind == "bearer" or bool(_FORM.match(v))):
            out.append(m.span(2))
    for value, spans, start in _literals(line):
        if m := _FORM.search(value):
            if not _STAND_IN.match(m[0]) and random_like(m[0]):
                out += _cut(spans, *m.span())
                continue
        if len(spans) > 1 and (m := _URL.search(value)) and is_credential(m[2], True):
            out += _cut(spans, *m.span(2))
        head = line[:start]
        n = _NAME.search(head) or _DEFINE.search(head)
        if not n and not head.strip(" \t(") and before:
            n = _BEFORE.search(before)
        if n and secret_name(n[1]) and is_credential(value, secret_name(n[1]) == "password"):
            out += spans
            continue
        if n and nominated(value) and not {w.lower() for w in _WORDS.findall(n[1])} & _PUBLIC and _ENDED.fullmatch(line, spans[-1][1]):
            out += spans
            continue
        out += [x for m in _OPTION.finditer(value) if is_credential(m[1], True) for x in _cut(spans, *m.span(1))]
        for m in _INNER.finditer(value):
            if (k := secret_name(m[1])) and is_credential(m[2], k == "password"):
                out += _cut(spans, *m.span(2))
    note = _COMMENT.search(line)
    for m in _BARE.finditer(line, 0 if config else note.start() if note else len(line)):
        if not _VARIABLE.match(m[2]) and (k := secret_name(m[1])) and is_credential(m[2], k == "password"):
            out.append(m.span(2))
    told = 0 if config else note.start() if note else len(line)
    out += [m.span(1) for rx in (_OPTION, _LOGIN) for m in rx.finditer(line, told) if is_credential(m[1], True)]
    if "-" in line:
        for m in _FLAG.finditer(line, told):
            if (k := secret_name(m[1])) and is_credential(m[2], k == "password"):
                out.append(m.span(2))
    return out


def find(text: str | None, config: bool = False) -> list[tuple[int, int, int]]:
    """(line number from 1, start, end) of each credential's characters, as offsets into the text."""
    if not text:
        return []
    out: list[tuple[int, int, int]] = []
    at, no, before, skip = 0, 0, "", -1
    for raw in re.split(r"(\r\n|\r|\n)", text) if "\r" in text else _keep(text):
        if raw in ("\r\n", "\r", "\n"):
            at += len(raw)
            continue
        no += 1
        if at >= skip and raw.strip():
            if (m := _PEM.search(raw)) and (end := _PEM_END.search(text, at + m.end())) and random_like("".join(_BODY.findall(text, at + m.end(), end.start()))):
                out.append((no, at + m.end(), at + m.end()))
                out += [(no, at + m.end() + b.start(), at + m.end() + b.end()) for b in re.finditer(r"(?<!\\)[A-Za-z0-9+/=]{8,}", text[at + m.end() : end.start()])]
                skip = at + len(raw) + 1 if end.start() < at + len(raw) else end.start()
            else:
                out += [(no, at + a, at + b) for a, b in line_spans(raw, before, config)]
        at += len(raw)
        if raw.strip():
            before = raw
    return out


def _keep(text: str) -> Iterator[str]:
    for x in text.split("\n"):
        yield x
        yield "\n"


def redact(text: str | None, config: bool = False) -> str | None:
    """The text with each credential's letters and digits blanked out, of the same length."""
    if not text:
        return text
    got = find(text, config)
    if not got:
        return text
    chars = list(text)
    for _, a, b in got:
        for i in range(a, b):
            if chars[i].isalnum() or chars[i] in "+/=!?@#%&*^~":
                if not (i and chars[i - 1] == "\\"):
                    chars[i] = "X"
    return "".join(chars)


def is_config(language: str | None, path: str | None) -> bool:
    return (language or "").strip().lower() in ("yaml", "yml", "shell", "sh", "bash", "ini", "toml", "env", "properties", "dockerfile") or (path or "").lower().endswith((".yaml", ".yml", ".sh", ".env", ".ini", ".toml", ".cfg", ".properties", ".conf"))


def scan(df: DataFrame, key: str = "id", text: str = "text", language: str = "language", path: str = "file_path") -> DataFrame:
    """(key, line_no, start, length) of each credential's characters in each row, columns counted from 1 in the text."""
    require(df, key, text, language, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, no, at, size = [], [], [], []
            for i, (t, lang, p) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())):
                for n, a, e in find(t, is_config(lang, p)):
                    rows.append(i), no.append(n), at.append(a + 1), size.append(e - a)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(no, pa.int64()), pa.array(at, pa.int64()), pa.array(size, pa.int64())], names=[key, "line_no", "start", "length"])

    kind = T.StructType([T.StructField(key, df.schema[key].dataType)] + [T.StructField(c, T.LongType()) for c in ("line_no", "start", "length")])
    return spread(df.select(key, text, language, path).filter(F.length(text) > 0)).mapInArrow(run, kind)


def redacted(text: Column, language: Column, path: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def clean(t, lang, p):
        import pandas as pd

        return pd.Series([redact(a, is_config(b, c)) for a, b, c in zip(t, lang, p)], dtype=object)

    return clean(text, language, path)


def found_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "code_input")).select("id", "line_no").distinct()


def redacted_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with its text as it may be kept."""
    src = spread(table(spark, sf_dir, "code_input").select("id", "text", "language", "file_path"))
    return src.select("id", redacted(F.col("text"), F.col("language"), F.col("file_path")).alias("text"))
