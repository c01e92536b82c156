"""Calls of models as column expressions.

A `Reply` takes the Column of prompts and gives the Column of responses, so a model call is part of the plan like any other
expression: `served` wraps a backend (Arrow batches of prompts on executors), `stored` takes responses that are a column
already, and any native expression will do. Nulls in prompts are read as empty texts; a failed call gives null.
"""

from __future__ import annotations

import json
import os
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Reply = Callable[[Column], Column]
SYSTEM = "You are a helpful assistant."


class Backend(Protocol):
    """Must be picklable; called on executors with the prompts of a batch."""

    def __call__(self, prompts: list[str], system: str) -> list[str | None]: ...


class FunctionBackend:
    """A backend of one function from prompt to response."""

    def __init__(self, answer: Callable[[str], str | None]):
        self.answer = answer

    def __call__(self, prompts: list[str], system: str) -> list[str | None]:
        return [self.answer(p) for p in prompts]


class HttpBackend:
    """A chat service with the usual completions interface. Busy and failing calls are tried again, each time after a longer wait; then they give null."""

    BUSY = (429, 500, 502, 503, 504)

    def __init__(self, url: str, model: str, key_variable: str = "API_KEY", timeout: float = 60, retries: int = 3, threads: int = 8, wait: float = 1.0):
        self.url, self.model, self.key_variable, self.timeout, self.retries, self.threads, self.wait = url, model, key_variable, timeout, retries, threads, wait

    def post(self, url: str, body: dict) -> dict | None:
        for k in range(self.retries):
            try:
                r = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get(self.key_variable, '')}"})
                with urllib.request.urlopen(r, timeout=self.timeout) as f:
                    return json.load(f)
            except urllib.error.HTTPError as e:
                if e.code not in self.BUSY:
                    return None
            except (OSError, ValueError):
                pass
            time.sleep(self.wait * 2**k)
        return None

    def chat(self, messages: list[dict]) -> str | None:
        got = self.post(self.url, {"model": self.model, "messages": messages})
        try:
            return got["choices"][0]["message"]["content"]
        except (TypeError, KeyError, IndexError):
            return None

    def __call__(self, prompts: list[str], system: str) -> list[str | None]:
        with ThreadPoolExecutor(self.threads) as pool:
            return list(pool.map(lambda p: self.chat([{"role": "system", "content": system}, {"role": "user", "content": p}]), prompts))

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        """Vectors of the texts from the service's embeddings address."""
        got = self.post(self.url.replace("chat/completions", "embeddings"), {"model": self.model, "input": texts})
        rows = {d["index"]: d["embedding"] for d in (got or {}).get("data", [])}
        return [rows.get(i) for i in range(len(texts))]


def served(backend: Backend, system: str = SYSTEM) -> Reply:
    """Responses of a backend, one call a batch of prompts."""

    @F.pandas_udf(T.StringType())
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(backend([x if isinstance(x, str) else "" for x in b], system), dtype=object)

    return ask


def stored(response: Column | str) -> Reply:
    """Responses that are there already."""
    return lambda prompt: F.col(response) if isinstance(response, str) else response


def template(text: str, /, **columns: Column) -> Column:
    """`{name}` fields become the given columns or those of the row; nulls become empty."""
    parts = re.split(r"\{(\w+)\}", text)
    return F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(columns.get(p, F.col(p)).cast("string"), F.lit("")) for i, p in enumerate(parts)])


def fenced(c: Column, language: str = r"\w*") -> Column:
    """What stands in the first code fence, or the whole where there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(c, rf"(?s)```{language}[ \t]*\n(.*?)```", 1), F.lit("")), c)


def unfenced_json(c: Column) -> Column:
    """A JSON text without the fence around it."""
    return F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"^\s*```(?:json)?\s*|\s*```\s*$", "")


def between_tags(c: Column, name: str) -> Column:
    """What stands between <name> and </name>; null where they don't."""
    return F.nullif(F.trim(F.regexp_extract(c, rf"(?s)<{name}>(.*?)</{name}>", 1)), F.lit(""))


def number(c: Column, pattern: str, kind: str = "double") -> Column:
    """The first group of the pattern as a number; null where it doesn't match."""
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), pattern, 1), F.lit("")).try_cast(kind)


def ask(df: DataFrame, prompt: Column | str, output: str, reply: Reply) -> DataFrame:
    """df with the response to each row's prompt."""
    return df.withColumn(output, reply(template(prompt) if isinstance(prompt, str) else prompt))
