"""Conversations and agents: several calls of a model for each row, as stages of one plan or as rounds over the rows still open."""

from __future__ import annotations

import re
import subprocess
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions.text import nz
from siltworks.operators.generation import RESPONSE, json_list
from siltworks.operators.relational import token_f1
from siltworks.operators.serving import Reply, ask, between_tags, number, template, unfenced_json
from siltworks.registry import register
from siltworks.runtime import durable, require

TURN = "struct<role:string,content:string>"


@register("consistent_chat_generator")
def consistent_chat(spark: SparkSession, topics: dict[str, list[str]], ask_queries: Reply, ask_answers: Reply, per_intent: int = 20, turns: int = 6) -> DataFrame:
    """(category, topic, conversation): per_intent dialogues a topic; the user's queries are one JSON list, the answers another, and turns are their pairs."""
    rows = [(c, t, k) for c in sorted(topics) for t in topics[c] for k in range(per_intent)]
    base = spark.createDataFrame(rows, "category string, topic string, k int")
    q = ask(base, f"Write {turns} queries of one user about {{topic}} ({{category}}) as a JSON list. Dialogue {{k}}.", "_q", ask_queries).withColumn("_qs", json_list(F.col("_q")))
    a = ask(q.filter(F.size("_qs") > 0), template("Answer these queries in turn as a JSON list.\n{l}", l=F.to_json("_qs")), "_a", ask_answers).withColumn("_as", json_list(F.col("_a")))
    n = F.least(F.size("_qs"), F.size("_as"), F.lit(turns))
    both = F.zip_with(F.slice("_qs", 1, n), F.slice("_as", 1, n), lambda x, y: F.array(F.struct(F.lit("user").alias("role"), x.alias("content")), F.struct(F.lit("assistant").alias("role"), y.alias("content"))))
    return a.filter(n > 0).select("category", "topic", F.flatten(both).alias("conversation"))


@register("multi_turn_conversation_generator")
def multi_turn(df: DataFrame, key: str, user: Reply, assistant: Reply, tool: Reply, task: str = "composition_task", functions: str = "functions", most_turns: int = 5, output: str = "conversations") -> DataFrame:
    """df with a conversation of a user, an assistant and tools, for the rows whose assistant says <final> within most_turns turns; all others are dropped.

    A turn is a user's message and the assistant's answer; an answer with <func_call> is first sent to the tool, whose result the
    assistant answers. Rounds are written to the shared folder and go on with the rows that are still open.
    """
    require(df, key, task, functions)
    live = df.select(key, F.col(task).alias("_task"), F.col(functions).alias("_fs"), F.array().cast(f"array<{TURN}>").alias("_c"))
    done: list[DataFrame] = []
    say = lambda role, c: F.array(F.struct(F.lit(role).alias("role"), F.trim(nz(c)).alias("content")))
    told = F.concat_ws("\n", F.transform("_c", lambda t: F.concat(t["role"], F.lit(": "), t["content"])))
    for _ in range(most_turns):
        d = ask(live, template("You are the user. Task: {_task}\nSo far:\n{h}", h=told), "_u", user).withColumn("_c", F.concat("_c", say("user", F.col("_u"))))
        d = ask(d, template("You are the assistant. Functions: {_fs}\nCall one as <func_call>, or end with <final>.\n{h}", h=told), "_a", assistant)
        d = d.withColumn("_f", F.coalesce(F.col("_a").contains("<func_call>"), F.lit(False))).withColumn("_c", F.concat("_c", say("assistant", F.col("_a"))))
        called = ask(d.filter("_f"), template("You are the tool. Functions: {_fs}\nCall: {_a}"), "_t", tool).withColumn("_c", F.concat("_c", say("tool", F.col("_t")))).drop("_t")
        called = ask(called, template("You are the assistant. Answer the tool's result, or end with <final>.\n{h}", h=told), "_a2", assistant).withColumn("_c", F.concat("_c", say("assistant", F.col("_a2")))).withColumn("_a", F.col("_a2")).drop("_a2")
        d = durable(d.filter("NOT _f").unionByName(called).select(key, "_task", "_fs", "_c", F.coalesce(F.col("_a").contains("<final>"), F.lit(False)).alias("_end")))
        done.append(d.filter("_end").select(key, F.col("_c").alias(output)))
        live = d.filter("NOT _end").drop("_end")
        if not live.limit(1).count():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return df.join(out, key)


@register("format_str_prompted_agentic_generator")
def agent_runs(df: DataFrame, text: str, step: Callable[[str], str | None], output: str = "generated_content", most_rounds: int = 50, stop: str = "<final>") -> DataFrame:
    """df with the trajectory (an array of messages) of an agent that starts from the filled template and goes on until it says `stop` or for most_rounds."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            out = []
            for start in b:
                said: list[str] = []
                seen = start or ""
                while len(said) < most_rounds:
                    got = step(seen)
                    if got is None:
                        break
                    said.append(got)
                    if stop in got:
                        break
                    seen += "\n" + got
                out.append(said)
            yield pd.Series(out, dtype=object)

    return df.withColumn(output, run(template(text)))


@register("file_context_generator")
def file_contexts(df: DataFrame, key: str, reply: Reply, files: str = "input_files", question: str = "question", output: str = "file_context") -> DataFrame:
    """df with a map from each requested file's name to its text by the model (JSON with the field content, or the whole response)."""
    require(df, key, files, question)
    each = ask(df.select(key, question, F.explode(F.array_distinct(files)).alias("_f")), template("Write the content of the file {_f} for this question as JSON with the field content.\n{q}", q=F.col(question)), RESPONSE, reply)
    body = F.coalesce(F.get_json_object(unfenced_json(F.col(RESPONSE)), "$.content"), F.col(RESPONSE), F.lit(""))
    got = each.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_f", body.alias("_b"))))).alias(output))
    return df.join(got, key, "left")


# --- questions for retrieval agents


@register("agenticrag_atomic_task_generator")
def atomic_tasks(df: DataFrame, key: str, reply: Reply, judge: Reply, input_key: str = "prompts", per_task: int = 10, most: int = 10) -> DataFrame:
    """(key, identifier, question, answer, refined_answer, llm_answer, golden_doc_answer, optional_answers, f1): questions that the model can't answer without the text but can with it.

    Stages: identifier of the text, conclusions (JSON list of at most per_task), a question and answer of each, a cleaned answer, the model's
    answer without the text (its score must be under 1) and with it (1 or more), other forms of the answer. At most `most` questions a text.
    """
    require(df, key, input_key)
    t = F.col(input_key)
    d = ask(df.select(key, input_key), template("Name what identifies this text.\n{t}", t=t), "identifier", reply)
    d = ask(d, template("List the conclusions of the text as a JSON list.\n{t}", t=t), "_c", reply)
    d = d.select(key, input_key, "identifier", F.posexplode(F.slice(F.coalesce(json_list(F.col("_c")), F.array().cast("array<string>")), 1, per_task)).alias("_i", "conclusion")).filter(F.col("_i") < most)
    d = ask(d, "Turn it into JSON with question and answer: {conclusion} ({identifier})", "_q", reply)
    j = unfenced_json(F.col("_q"))
    d = d.withColumns({"question": F.get_json_object(j, "$.question"), "answer": F.get_json_object(j, "$.answer")}).filter((F.length("question") > 0) & (F.length("answer") > 0))
    d = ask(d, "Give the answer alone.\nQ: {question}\nA: {answer}", "refined_answer", reply)
    d = ask(d, "{question}", "llm_answer", reply)
    d = ask(d, template("{question}\n{t}", t=t), "golden_doc_answer", reply)
    grade = lambda c, out: ask(d, f"Score the answer from 0 to 2.\nQ: {{question}}\nTruth: {{refined_answer}}\nA: {{{c}}}", "_s", judge).withColumn(out, F.coalesce(number(F.col("_s"), r"(\d+(?:\.\d+)?)"), F.lit(0.0))).drop("_s")
    d = grade("llm_answer", "llm_score")
    d = grade("golden_doc_answer", "golden_doc_score").filter("llm_score < 1 AND golden_doc_score >= 1")
    d = ask(d, "List other forms of the answer as a JSON list.\n{refined_answer}", "_o", reply).withColumn("optional_answers", F.coalesce(json_list(F.col("_o")), F.array().cast("array<string>")))
    return d.select(key, "identifier", "question", "answer", "refined_answer", "llm_answer", "golden_doc_answer", "optional_answers", token_f1(F.col("golden_doc_answer"), F.col("refined_answer")).alias("f1"))


@register("agenticrag_depth_qa_generator")
def depth_questions(df: DataFrame, key: str, reply: Reply, judge: Reply, input_key: str = "question", rounds: int = 2) -> DataFrame:
    """df with depth_question: in each round the question's subject is replaced by what leads to it, if the model agrees that this is a wider notion; only rows that it then can't answer stay."""
    require(df, key, input_key)
    d = df.withColumn("depth_question", F.col(input_key))
    for _ in range(rounds):
        d = ask(d, "What leads to the subject of this question? {depth_question}", "_id", reply)
        d = ask(d, "Is it a wider notion than the subject? yes or no. {_id}: {depth_question}", "_ok", judge)
        d = ask(d, "Ask for the same by way of {_id}: {depth_question}", "_new", reply)
        d = d.withColumn("depth_question", F.when(F.lower(nz("_ok")).rlike(r"\byes\b") & (F.length(F.trim("_new")) > 0), F.trim("_new")).otherwise(F.col("depth_question"))).drop("_id", "_ok", "_new")
    d = ask(d, "Can you answer this? Score from 0 to 2. {depth_question}", "_s", judge)
    return d.filter(F.coalesce(number(F.col("_s"), r"(\d+(?:\.\d+)?)"), F.lit(0.0)) < 1).drop("_s")


@register("agenticrag_width_qa_generator")
def width_questions(pairs: DataFrame, reply: Reply, judge: Reply, first: str = "first", second: str = "second", output: str = "generated_width_task") -> DataFrame:
    """pairs of neighbouring questions (rows of adjacent_pairs) with one question that asks both; only those that the model accepts and can't answer stay."""
    require(pairs, first, second)
    d = ask(pairs, template("Ask both as one question.\n1: {a}\n2: {b}", a=F.col(first), b=F.col(second)), output, reply)
    d = ask(d, template("Does it ask both? State 1 or 0.\n{o}", o=F.col(output)), "_v", judge)
    d = ask(d, template("Can you answer this? Score from 0 to 2. {o}", o=F.col(output)), "_s", judge)
    return d.filter((number(F.col("_v"), r"(\d+)", "int") == 1) & (F.coalesce(number(F.col("_s"), r"(\d+(?:\.\d+)?)"), F.lit(0.0)) < 1)).drop("_v", "_s")


# --- running code


def run_snippet(code: str | None, seconds: float = 15, memory_mb: int = 1024) -> tuple[str, str]:
    """(PASS or FAIL, log) of a Python snippet, run by itself in a process of its own with limits on time and memory. Blank code fails."""
    if not code or not code.strip():
        return "FAIL", "no code"

    def limit() -> None:
        import resource

        resource.setrlimit(resource.RLIMIT_AS, (memory_mb * 2**20,) * 2)
        resource.setrlimit(resource.RLIMIT_CPU, (int(seconds) + 1,) * 2)

    try:
        got = subprocess.run([sys.executable, "-I", "-c", code], capture_output=True, timeout=seconds, preexec_fn=limit, env={"PATH": ""}, cwd="/tmp")
    except subprocess.TimeoutExpired:
        return "FAIL", f"timeout after {seconds} s"
    log = (got.stdout + got.stderr).decode("utf-8", "replace")
    return ("PASS" if got.returncode == 0 else "FAIL"), log


@register("code_sandbox_sample_evaluator")
def sandbox(df: DataFrame, input_key: str = "code", seconds: float = 15, status: str = "sandbox_status", log: str = "sandbox_log") -> DataFrame:
    """df with PASS or FAIL and the log of running each snippet. It limits time and memory, but is no protection against hostile code."""
    require(df, input_key)

    @F.pandas_udf("status string, log string")
    def run(code: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([run_snippet(c if isinstance(c, str) else None, seconds) for c in code], columns=["status", "log"])

    return df.withColumn("_r", run(F.col(input_key))).withColumns({status: F.col("_r.status"), log: F.col("_r.log")}).drop("_r")
