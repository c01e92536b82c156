"""Operators on questions with SQL: difficulty, execution, comparison of results, prompts, voting.

Queries run on the databases of an `Engine`: `SparkEngine` has them as catalogs of temporary views of this session, and plans
and runs each different (database, query) once; `SqliteEngine` runs them on executors from files.
"""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions.text import nz
from siltworks.operators.generation import RESPONSE
from siltworks.operators.serving import Reply, ask, template
from siltworks.registry import register
from siltworks.runtime import require

# --- difficulty by parts


def sql_difficulty(c: Column) -> Column:
    """Score of a query's parts. Like the rule it follows, it looks for words as they stand, also inside other words."""
    t = F.lower(nz(c))
    has = lambda *w: F.greatest(*[t.contains(x).cast("int") for x in (*w, w[0])])
    n = lambda w: F.regexp_count(t, F.lit(w))
    columns = F.regexp_extract(t, r"(?s)select\s+(distinct\s+)?(.+?)\s+from", 2)
    return (
        2 * t.rlike(r"\( *select").cast("int") + n(" join ") + (t.contains(",") & t.contains("from")).cast("int") + ((n(" and ") + n(" or ")) >= 2).cast("int") + has("in", "exists", "like") + has("group by") + has("having")
        + has("cast", "round", "substring", "date", "coalesce") + has("order by") + has("limit") + 2 * has("union", "intersect", "except") + columns.contains(",").cast("int"))


def level(score: Column, thresholds: list[int], labels: list[str]) -> Column:
    """The label of the first threshold that the score doesn't exceed, else the last one."""
    if len(labels) != len(thresholds) + 1:
        raise ValueError("there is one label more than thresholds")
    out = F.lit(labels[-1])
    for t, name in reversed(list(zip(thresholds, labels))):
        out = F.when(score <= t, F.lit(name)).otherwise(out)
    return out


@register("sql_component_classifier")
def component_classifier(df: DataFrame, thresholds: list[int] = [2, 4, 6], labels: list[str] = ["easy", "medium", "hard", "extra"], input_key: str = "SQL", output_key: str = "sql_component_difficulty") -> DataFrame:  # noqa: B006
    """df with the difficulty of each query by its parts."""
    require(df, input_key)
    return df.withColumn(output_key, level(sql_difficulty(F.col(input_key)), thresholds, labels))


# --- execution


class Engine(Protocol):
    def explain(self, queries: DataFrame) -> DataFrame:
        """(db_id, sql) -> (db_id, sql, ok)."""

    def execute(self, queries: DataFrame) -> DataFrame:
        """(db_id, sql) -> (db_id, sql, ok, signature): signature is null for a failed or empty result."""


class SqliteEngine:
    """Databases in files, run on executors with a limit on the steps of a query; `path` names the file of a database."""

    def __init__(self, path: Callable[[str], str], steps: int = 20_000_000):
        self.path, self.steps = path, steps

    def _run(self, db: str | None, sql: str | None, prefix: str = "") -> tuple[bool, str | None]:
        try:
            con = sqlite3.connect(f"file:{self.path(db)}?mode=ro", uri=True)
        except (sqlite3.Error, TypeError):
            return False, None
        try:
            left = [self.steps // 1000]

            def tick() -> int:
                left[0] -= 1
                return int(left[0] < 0)

            con.set_progress_handler(tick, 1000)
            rows = con.execute(prefix + (sql or "")).fetchall()
            # a result is compared as a set of rows, nulls as empty texts
            return True, repr(sorted({tuple("" if v is None else str(v) for v in r) for r in rows})) if rows else None
        except (sqlite3.Error, sqlite3.Warning, TypeError):
            return False, None
        finally:
            con.close()

    def _each(self, queries: DataFrame, prefix: str) -> DataFrame:
        @F.pandas_udf("ok boolean, signature string")
        def run(db: pd.Series, sql: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([self._run(a, b, prefix) for a, b in zip(db, sql)], columns=["ok", "signature"])

        return queries.distinct().withColumn("_r", run("db_id", "sql")).select("db_id", "sql", "_r.ok", "_r.signature")

    def explain(self, queries: DataFrame) -> DataFrame:
        return self._each(queries, "EXPLAIN ").drop("signature")

    def execute(self, queries: DataFrame) -> DataFrame:
        return self._each(queries, "")


#: A statement that changes anything is never run.
_COMMENT, _SELECT = re.compile(r"/\*.*?\*/|--[^\n]*", re.S), re.compile(r"\s*(?:select|with)\b", re.I)


class SparkEngine:
    """Databases as views of this session. Queries are planned on the driver, each different one once; `most` bounds their number."""

    def __init__(self, spark: SparkSession, most: int = 10_000):
        self.spark, self.most = spark, most

    def _queries(self, queries: DataFrame) -> list:
        rows = queries.filter("sql IS NOT NULL").distinct().limit(self.most + 1).collect()
        if len(rows) > self.most:
            raise ValueError(f"more than {self.most} different queries; use an engine that runs on executors")
        return rows

    def _make(self, rows: list, kind: str) -> DataFrame:
        return self.spark.createDataFrame(rows, kind)

    def explain(self, queries: DataFrame) -> DataFrame:
        out = []
        for r in self._queries(queries):
            try:
                if not _SELECT.match(_COMMENT.sub(" ", r["sql"])):
                    raise ValueError("not a query")
                self.spark.sql(r["sql"])
                out.append((r["db_id"], r["sql"], True))
            except Exception:  # any error of a foreign query means that it can't run
                out.append((r["db_id"], r["sql"], False))
        return self._make(out, "db_id string, sql string, ok boolean")

    def execute(self, queries: DataFrame) -> DataFrame:
        out = []
        for r in self._queries(queries):
            try:
                if not _SELECT.match(_COMMENT.sub(" ", r["sql"])):
                    raise ValueError("not a query")
                # the result stays on executors; a sum over the hashes of its different rows is its signature
                got = self.spark.sql(r["sql"])
                named = got.toDF(*[f"c{i}" for i in range(len(got.columns))])
                one = named.select(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in named.columns]).alias("h")).distinct().agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("h")).first()
                out.append((r["db_id"], r["sql"], True, f"{one['n']}:{one['h']}" if one["n"] else None))
            except Exception:  # any error of a foreign query means that it can't run
                out.append((r["db_id"], r["sql"], False, None))
        return self._make(out, "db_id string, sql string, ok boolean, signature string")


def selects(c: Column) -> Column:
    """Whether a query, without comments, begins with SELECT or WITH."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(nz(c), r"(?s)/\*.*?\*/", ""), r"--[^\n]*", ""))).rlike(r"^\s*(?:select|with)")


def _kept(df: DataFrame, run: Callable[[DataFrame], DataFrame], sql: str, db: str) -> DataFrame:
    require(df, sql, db)
    ok = run(df.filter(selects(F.col(sql))).select(F.col(db).alias("db_id"), F.col(sql).alias("sql"))).filter("ok").select(F.col("db_id").alias("_d"), F.col("sql").alias("_q"))
    return df.join(ok, df[db].eqNullSafe(F.col("_d")) & (df[sql] == F.col("_q")), "left_semi")


@register("sql_executability_filter")
def executability_filter(df: DataFrame, engine: Engine, sql: str = "SQL", db: str = "db_id") -> DataFrame:
    """The rows whose query is a SELECT or WITH that can be planned on its database."""
    return _kept(df, engine.explain, sql, db)


@register("sql_execution_filter")
def execution_filter(df: DataFrame, engine: Engine, sql: str = "SQL", db: str = "db_id") -> DataFrame:
    """The rows whose query is a SELECT or WITH that runs on its database."""
    return _kept(df, engine.execute, sql, db)


def sql_of(response: Column) -> Column:
    """The last SQL fence of a response that isn't empty, else what stands from SELECT to the first FROM; empty without either."""
    fences = F.filter(F.regexp_extract_all(nz(response), F.lit(r"(?is)```sql\s*(.*?)\s*```"), F.lit(1)), lambda x: F.trim(x) != "")
    return F.when(F.size(fences) > 0, F.trim(F.element_at(fences, -1))).otherwise(F.trim(F.regexp_extract(nz(response), r"(?is)(select.*?from)", 1)))


@register("text2sql_cot_voting_generator")
def vote(df: DataFrame, key: str, engine: Engine, responses: str = "cot_responses", db: str = "db_id", output: str = "cot_reasoning") -> DataFrame:
    """df with the response whose query's result most others share, and its query as SQL; rows without a query that runs are dropped.

    Results are compared as sets of rows. Without two equal results the shortest query counts; of a group with equal ones the first response.
    """
    require(df, key, responses, db)
    each = df.select(key, F.col(db).alias("db_id"), F.posexplode(responses).alias("_i", "_r")).withColumn("sql", sql_of(F.col("_r"))).filter("sql != ''")
    ran = each.join(engine.execute(each.select("db_id", "sql")).filter("ok AND signature IS NOT NULL").select("db_id", "sql", "signature"), ["db_id", "sql"])
    group = ran.groupBy(key, "signature").agg(F.count("*").alias("n"), F.min(F.struct("_i", "_r", "sql")).alias("first"), F.min(F.struct(F.length("sql").alias("l"), "_i", "_r", "sql")).alias("short"))
    best = group.groupBy(key).agg(F.max("n").alias("n"), F.max_by("first", F.struct("n", -F.col("first._i"))).alias("first"), F.min("short").alias("short"))
    take = lambda f: F.when(F.col("n") > 1, F.col("first")[f]).otherwise(F.col("short")[f])
    got = best.select(key, take("_r").alias(output), take("sql").alias("SQL"))
    return df.drop(output, "SQL").join(got, key)


@register("sql_execution_classifier")
def execution_classifier(df: DataFrame, key: str, engine: Engine, reply: Reply, generations: int = 10, thresholds: list[int] = [2, 5, 9], labels: list[str] = ["extra", "hard", "medium", "easy"], sql: str = "SQL", db: str = "db_id", prompt: str = "prompt", output: str = "sql_execution_difficulty") -> DataFrame:  # noqa: B006
    """df with a difficulty by how many of the model's queries have the result of the given one; `gold error` where that one doesn't run."""
    require(df, key, sql, db, prompt)
    made = ask(df.select(key, F.col(db).alias("db_id"), prompt, F.explode(F.sequence(F.lit(1), F.lit(generations))).alias("_k")), template("{p}\nAttempt {_k}.", p=F.col(prompt)), RESPONSE, reply).select(key, "db_id", sql_of(F.col(RESPONSE)).alias("sql"))
    gold = df.select(key, F.col(db).alias("db_id"), F.col(sql).alias("sql"))
    ran = engine.execute(made.filter("sql != ''").select("db_id", "sql").union(gold.select("db_id", "sql")).distinct())
    want = gold.join(ran, ["db_id", "sql"], "left").select(key, F.coalesce("ok", F.lit(False)).alias("_ok"), F.coalesce("signature", F.lit("")).alias("_want"))
    hits = made.join(ran.filter("ok"), ["db_id", "sql"]).join(want, key).groupBy(key).agg(F.sum((F.coalesce("signature", F.lit("")) == F.col("_want")).cast("int")).alias("_hits"))
    n = F.coalesce("_hits", F.lit(0))
    return df.join(want.select(key, "_ok"), key).join(hits, key, "left").withColumn(output, F.when(~F.col("_ok"), "gold error").otherwise(level(n, thresholds, labels))).drop("_ok", "_hits")


# --- prompts and generation


def schema_text(spark: SparkSession, tables: dict[str, list[tuple[str, str]]]) -> str:
    """CREATE TABLE texts of a schema: table -> (column, type)."""
    return "\n".join(f"CREATE TABLE {t} ({', '.join(f'{c} {k}' for c, k in cols)});" for t, cols in sorted(tables.items()))


def schemas(spark: SparkSession, databases: dict[str, dict[str, list[tuple[str, str]]]]) -> DataFrame:
    """(db_id, schema, n_columns), a row a database."""
    return spark.createDataFrame([(d, schema_text(spark, t), sum(map(len, t.values()))) for d, t in sorted(databases.items())], "db_id string, schema string, n_columns int")


@register("text2sql_prompt_generator")
def prompts(df: DataFrame, of: DataFrame, question: str = "question", db: str = "db_id", evidence: str | None = "evidence", output: str = "prompt") -> DataFrame:
    """df with a prompt of the database's schema, the evidence and the question. of: rows of schemas; an unknown database has an empty schema."""
    require(df, question, db)
    known = of.select(F.col("db_id").alias(db), "schema")
    told = F.col(evidence) if evidence and evidence in df.columns else F.lit("")
    return df.join(known, db, "left").withColumn(output, template("Schema:\n{schema}\nEvidence: {e}\nQuestion: {q}", q=F.col(question), e=told)).drop("schema")


@register("sql_generator")
def generate_sql(of: DataFrame, reply: Reply, n: int = 300, kinds: tuple[str, ...] = ("simple", "moderate", "complex", "window function")) -> DataFrame:
    """(db_id, SQL, sql_complexity_type): n queries a database, kinds in turn; responses without a query go."""
    each = of.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("sql_complexity_type", F.element_at(F.array(*map(F.lit, kinds)), (F.col("_i") % len(kinds) + 1).cast("int")))
    got = ask(each, "Write a {sql_complexity_type} query over this schema. Number {_i}.\n{schema}", RESPONSE, reply)
    return got.select("db_id", sql_of(F.col(RESPONSE)).alias("SQL"), "sql_complexity_type").filter("SQL != ''")


@register("sql_by_column_generator")
def generate_by_column(of: DataFrame, reply: Reply, per_column: int = 5) -> DataFrame:
    """(db_id, SQL): per_column queries for each column of a database."""
    each = of.filter("n_columns > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("n_columns") * per_column)))
    got = ask(each, "Write a query over one column of this schema. Number {_i}.\n{schema}", RESPONSE, reply)
    return got.select("db_id", sql_of(F.col(RESPONSE)).alias("SQL")).filter("SQL != ''")


@register("sql_variation_generator")
def variations(df: DataFrame, key: str, reply: Reply, k: int = 10, sql: str = "SQL") -> DataFrame:
    """k variations of each query, with sql_variation_type; a query without any stays as it is, with a null type."""
    require(df, key, sql)
    ways = ("filter", "aggregate", "join", "order", "nest")
    each = df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("sql_variation_type", F.element_at(F.array(*map(F.lit, ways)), (F.col("_i") % len(ways) + 1).cast("int")))
    new = ask(each, template("Vary the query by its {sql_variation_type}. Number {_i}.\n{s}", s=F.col(sql)), RESPONSE, reply).withColumn(sql, sql_of(F.col(RESPONSE))).filter(F.col(sql) != "").drop("_i", RESPONSE)
    bare = df.join(new.select(key).distinct(), key, "left_anti").withColumn("sql_variation_type", F.lit(None).cast("string"))
    return new.unionByName(bare)


@register("text2sql_cot_generator")
def chains(df: DataFrame, key: str, reply: Reply, samples: int = 3, question: str = "question", sql: str = "SQL", output: str = "cot_reasoning") -> DataFrame:
    """df with an array of `samples` explanations of how the question becomes the query, in order."""
    require(df, key, question, sql)
    each = ask(df.select(key, question, sql, F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("_i")), template("Explain step by step how the question becomes the query. Sample {_i}.\nQ: {q}\nSQL: {s}", q=F.col(question), s=F.col(sql)), RESPONSE, reply)
    got = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_i", RESPONSE))).alias("_r")).select(key, F.col(f"_r.{RESPONSE}").alias(output))
    return df.join(got, key, "left")


@register("text2sql_question_generator")
def questions(df: DataFrame, key: str, reply: Reply, embed: Callable[[list[str]], list], k: int = 5, sql: str = "SQL", output: str = "question") -> DataFrame:
    """df with the most typical of k questions for each query: the one of least total cosine distance to the others, the first of equals."""
    import numpy as np

    require(df, key, sql)
    each = ask(df.select(key, sql, F.explode(F.sequence(F.lit(1), F.lit(k))).alias("_i")), template("Write a question that this query answers. Candidate {_i}.\n{s}", s=F.col(sql)), RESPONSE, reply)
    all_ = each.filter(F.length(F.trim(RESPONSE)) > 0).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_i", RESPONSE))).alias("_r"))

    @F.pandas_udf("string")
    def typical(lists: pd.Series) -> pd.Series:
        out = []
        for q in lists:
            q = list(q)
            x = np.array(embed(q), float)
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            out.append(q[int((1 - x @ x.T).sum(1).round(9).argmin())])
        return pd.Series(out, dtype=object)

    return df.drop(output).join(all_.select(key, typical(F.col(f"_r.{RESPONSE}")).alias(output)), key, "left")


def compare_results(a: DataFrame, b: DataFrame) -> bool:
    """Whether two results have the same columns and the same rows, as often, in any order; nulls count as empty texts."""
    if sorted(a.columns) != sorted(b.columns):
        return False
    text = lambda d: d.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in sorted(d.columns)])
    x, y = text(a), text(b)
    return x.exceptAll(y).limit(1).count() == 0 and y.exceptAll(x).limit(1).count() == 0
