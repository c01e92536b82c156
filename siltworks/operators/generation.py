"""Operators that ask a model once for each row: a prompt, a reply, a parser of its response.

Each is named in TASKS with its prompt's template (fields are columns that the caller names), the parser that turns the
response into columns, and the condition that drops rows, if any. All of it but the reply is native. Templates are short
and ours; another one can be given. Rows are never lost for a failed call: the response is null then and parsed as such.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.operators.serving import Reply, ask, between_tags, fenced, number, template, unfenced_json
from siltworks.registry import register
from siltworks.runtime import require

RESPONSE = "_response"


def whole(c: Column) -> Column:
    return c


def score_1_to_5(c: Column) -> Column:
    """The first whole number if it is 1 to 5, else 0."""
    n = number(c, r"(\d+)", "int")
    return F.when(n.between(1, 5), n).otherwise(F.lit(0))


def first_token(c: Column) -> Column:
    """The first token of the first line as a number."""
    return number(c, r"^\s*([^\s,;]+)")


def rating(c: Column) -> Column:
    """What `Rating:` says, else -1."""
    return F.coalesce(number(c, r"(?i)rating\s*:\s*\**\s*(-?\d+(?:\.\d+)?)"), F.lit(-1.0))


def json_list(c: Column, kind: str = "array<string>") -> Column:
    """A JSON list, also with text around it; null where it can't be read."""
    return F.from_json(F.nullif(F.regexp_extract(unfenced_json(c), r"(?s)(\[.*\])", 1), F.lit("")), kind)


def section(title: str) -> Callable[[Column], Column]:
    """The text under a heading `### title`, up to the next heading or the end."""
    return lambda c: F.nullif(F.regexp_replace(F.regexp_extract(F.coalesce(c, F.lit("")), rf"(?is)###\s*{title}\s*:?(.*?)(?=\n\s*###|\Z)", 1), r"^\s+|\s+$", ""), F.lit(""))


def six_scores(c: Column) -> Column:
    """A list of exactly six numbers, else six NaN."""
    got = json_list(c, "array<double>")
    return F.when(F.size(got) == 6, got).otherwise(F.array_repeat(F.lit(float("nan")), 6))


def said(word: str) -> Callable[[Column], Column]:
    return lambda c: F.coalesce(F.lower(c).rlike(word), F.lit(False))


@dataclass(frozen=True)
class Task:
    """fields: names of the input columns in the template. outputs: column -> parser of the response. keep: of the outputs, which rows stay."""

    text: str
    fields: tuple[str, ...]
    outputs: dict[str, Callable[[Column], Column]]
    keep: Callable[[], Column] | None = None
    drop: tuple[str, ...] = field(default=())


def _one(text: str, fields: str, output: str, parse: Callable[[Column], Column] = whole, keep: Callable[[], Column] | None = None) -> Task:
    return Task(text, tuple(fields.split()), {output: parse}, keep)


TASKS: dict[str, Task] = {
    # text in general
    "prompted_generator": _one("{raw_content}", "raw_content", "generated_content"),
    "prompted_refiner": _one("Rewrite the text. Give the text only.\n{raw_content}", "raw_content", "raw_content"),
    "prompted_evaluator": _one("Rate the text from 1 to 5.\n{raw_content}", "raw_content", "eval", score_1_to_5),
    "prompted_filter": _one("Rate the text from 1 to 5.\n{raw_content}", "raw_content", "eval", score_1_to_5, lambda: F.col("eval").between(1, 5)),
    "llm_language_filter": _one("Name the language of the text by its two-letter code only.\n{raw_content}", "raw_content", "language_label", lambda c: F.lower(F.trim(c)), lambda: F.col("language_label").isin("en")),
    "phi4qa_generator": _one("Turn the passage into questions and answers.\n{raw_content}", "raw_content", "generated_content"),
    "speech2text_generator": _one("Write down what is said in the recording.\n{raw_content}", "raw_content", "generated_content"),
    "prompted_vqa_generator": _one("Describe the picture.\n{raw_content}", "raw_content", "generated_content"),
    "meta_sample_evaluator": _one("Rate the text from 1 to 5 in six respects: quality, difficulty, style, facts, use, safety. Answer with a list of six numbers.\n{raw_content}", "raw_content", "MetaScores", six_scores),
    "extract_smiles_from_text_generator": _one("List the compounds of the text as JSON objects with abbreviation, full_name and smiles. Known abbreviations: {abbreviations}\n{text}", "text abbreviations", "synth_smiles", lambda c: json_list(c, "array<struct<abbreviation:string,full_name:string,smiles:string>>")),
    # code
    "code_quality_sample_evaluator": Task("Rate how well the code does what is asked, from 0 to 10, as `Score: n` and `Feedback: ...`.\nTask: {instruction}\nCode:\n{code}", ("instruction", "code"), {"quality_score": lambda c: F.coalesce(number(c, r"(?i)score\s*:\s*\**\s*(\d+)", "int"), F.lit(0)), "quality_feedback": lambda c: F.when(number(c, r"(?i)score\s*:\s*\**\s*(\d+)").isNotNull(), F.trim(F.regexp_extract(c, r"(?is)feedback\s*:\s*(.*)", 1))).otherwise(F.lit(""))}),
    "code_quality_score_filter": Task("Rate how well the code does what is asked, from 0 to 10, as `Score: n` and `Feedback: ...`.\nTask: {instruction}\nCode:\n{code}", ("instruction", "code"), {"quality_score": lambda c: F.coalesce(number(c, r"(?i)score\s*:\s*\**\s*(\d+)", "int"), F.lit(0))}, lambda: F.col("quality_score").between(7, 10) | (F.col("quality_score") == 0)),
    "code_code_to_instruction_generator": _one("State the task that this code solves.\n{code}", "code", "generated_instruction"),
    "code_enhancement_instruction_generator": _one("State the task more fully and more exactly.\n{messages}", "messages", "generated_instruction"),
    "code_instruction_to_code_generator": _one("Write the code for this task.\n{instruction}", "instruction", "generated_code", lambda c: fenced(c)),
    # conversations
    "func_call_conversation_sample_evaluator": _one('Rate the conversation as {"score": n}.\n{conversations}'.replace('{"score": n}', "a JSON object with the field score"), "conversations", "score", lambda c: F.coalesce(F.get_json_object(unfenced_json(c), "$.score").try_cast("double"), F.lit(0.0))),
    "composition_task_filter": _one("Can the whole be done by its parts? Answer <ans>yes</ans> or <ans>no</ans>.\nWhole: {composition_task}\nParts: {sub_tasks}", "composition_task sub_tasks", "runable_label", lambda c: F.coalesce(F.lower(between_tags(c, "ans")) == "yes", F.lit(False)).cast("int"), lambda: F.col("runable_label") == 1),
    "scenario_extract_generator": _one("Describe the scenario of this conversation.\n{chat}", "chat", "scenario"),
    "scenario_expand_generator": _one("Change the scenario into a new one of the same kind.\n{scenario}", "scenario", "modified_scenario"),
    "atom_task_generator": _one("State one small task of this scenario.\n{scenario}", "scenario", "atom_task"),
    "sequential_task_generator": Task("Give a task that follows this one under `### Subsequent Task`, and both as one under `### Composition Task`.\n{task}", ("task",), {"subsequent_task": section("Subsequent Task"), "composition_task": section("Composition Task")}),
    "para_seq_task_generator": Task("Give a task beside this one under `### Parallel Task`, one that follows under `### Subsequent Task`, and all as one under `### Composition Task`.\n{task}", ("task",), {"parallel_task": section("Parallel Task"), "subsequent_task": section("Subsequent Task"), "composition_task": section("Composition Task")}),
    "function_generator": _one("Specify the functions that these tasks need, as JSON.\nWhole: {composition_task}\nParts: {sub_tasks}", "composition_task sub_tasks", "functions"),
    # knowledge cleaning
    "kbc_text_cleaner": _one("Clean the text; put it between <cleaned_start> and <cleaned_end>.\n{raw_chunk}", "raw_chunk", "cleaned_chunk", lambda c: F.coalesce(F.nullif(F.trim(F.regexp_extract(c, r"(?s)<cleaned_start>(.*?)<cleaned_end>", 1)), F.lit("")), F.trim(c))),
    # reasoning
    "reasoning_answer_generator": _one("Solve the problem step by step; put the answer in \\boxed{}.\n{instruction}".replace("\\boxed{}", "a box"), "instruction", "generated_cot"),
    "reasoning_question_solvable_sample_evaluator": _one("Can this problem be solved as it is stated?\n{instruction}", "instruction", "solvable"),
    "reasoning_question_difficulty_sample_evaluator": _one("Rate the difficulty as `Rating: x`.\n{instruction}", "instruction", "difficulty_score", rating),
    "reasoning_question_filter": _one('Is this a sound problem? Answer as JSON with the field judgement_test.\n{math_problem}', "math_problem", "judgement", lambda c: F.coalesce(F.lower(F.get_json_object(unfenced_json(c), "$.judgement_test")) == "true", F.lower(c).rlike(r'"judgement_test"\s*:\s*"?true'), F.lit(False)), lambda: F.col("judgement")),
    "reasoning_question_fusion_generator": _one("Fuse the two problems into one.\n1: {problem_1}\n2: {problem_2}", "problem_1 problem_2", "fused"),
    # instruction tuning
    "alpagasus_sample_evaluator": _one("Rate the response from 0 to 5; the rating comes first.\nInstruction: {instruction}\nInput: {input}\nResponse: {output}", "instruction input output", "AlpagasusScore", first_token),
    "alpagasus_filter": _one("Rate the response from 0 to 5; the rating comes first.\nInstruction: {instruction}\nInput: {input}\nResponse: {output}", "instruction input output", "AlpagasusScore", first_token, lambda: F.col("AlpagasusScore").between(3, 5)),
    "treeinstruct_sample_evaluator": _one("How many nodes has the semantic tree of this instruction? The number comes first.\n{instruction}", "instruction", "TreeinstructScore", first_token),
    "treeinstruct_filter": _one("How many nodes has the semantic tree of this instruction? The number comes first.\n{instruction}", "instruction", "TreeinstructScore", first_token, lambda: F.col("TreeinstructScore").between(7, 100)),
    # text to SQL
    "text2sql_correspondence_filter": _one("Does the query answer the question? Answer yes or no in a fence.\nQuestion: {question}\nEvidence: {evidence}\nQuery: {SQL}", "question evidence SQL", "corresponds", lambda c: F.coalesce(F.lower(F.trim(fenced(c))).startswith("yes"), F.lit(False)), lambda: F.col("corresponds")),
}


def run_task(df: DataFrame, task: str, reply: Reply, inputs: dict[str, str] | None = None, outputs: dict[str, str] | None = None, prompt: str | None = None, keep: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """df with the task's output columns, without the rows that its condition drops.

    inputs, outputs: the caller's names of the task's fields and output columns. prompt: another template. keep: another condition.
    """
    t = TASKS[task]
    named = {f: (inputs or {}).get(f, f) for f in t.fields}
    require(df, *named.values())
    got = ask(df, template(prompt or t.text, **{f: F.col(c) for f, c in named.items()}), RESPONSE, reply)
    new = {o: (outputs or {}).get(o, o) for o in t.outputs}
    if t.keep and new != {o: o for o in t.outputs} and not keep:
        raise ValueError(f"{task}: give a condition with columns of other names")
    got = got.withColumns({new[o]: parse(F.col(RESPONSE)) for o, parse in t.outputs.items()}).drop(RESPONSE)
    cond = keep(got) if keep else t.keep() if t.keep else None
    return got if cond is None else got.filter(F.coalesce(cond, F.lit(False)))


def _named(task: str) -> Callable[..., DataFrame]:
    def op(df: DataFrame, reply: Reply, **more: object) -> DataFrame:
        return run_task(df, task, reply, **more)

    op.__name__ = task
    op.__doc__ = f"Asks once a row: {', '.join(TASKS[task].fields)} -> {', '.join(TASKS[task].outputs)}."
    return op


for _task in TASKS:
    register(_task)(_named(_task))


@register("format_str_prompted_generator")
def format_str_prompted(df: DataFrame, text: str, reply: Reply, output: str = "generated_content", schema: str | None = None) -> DataFrame:
    """The response to a template with named fields; with a schema (DDL) it is read as JSON, and rows that can't be read go."""
    got = ask(df, text, output, reply)
    if not schema:
        return got
    return got.withColumn(output, F.from_json(unfenced_json(F.col(output)), schema, {"mode": "PERMISSIVE"})).filter(F.col(output).isNotNull())


@register("embedding_generator")
def embedding_generator(df: DataFrame, embed: Callable[[list[str]], list], input_key: str = "text", output_key: str = "embeddings") -> DataFrame:
    """df with the vector of each text; embed is called on executors with the texts of a batch."""
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(embed([t if isinstance(t, str) else "" for t in texts]), dtype=object)

    require(df, input_key)
    return df.withColumn(output_key, run(F.col(input_key)))


@register("random_domain_knowledge_row_generator")
def random_domain_rows(spark: object, n: int, domains: list[str], reply: Reply, output: str = "generated_content", seed: int = 42) -> DataFrame:
    """n new rows: a domain drawn by the hash of the row's number and the seed, and the model's text about it."""
    pick = F.element_at(F.array(*map(F.lit, domains)), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(len(domains))) + 1).cast("int"))
    return ask(spark.range(n).select("id", pick.alias("domain")), "Write a piece of knowledge about {domain}. Piece {id}.", output, reply)


@register("code_instruction_generator")
def code_instructions(df: DataFrame, reply: Reply, input_key: str = "prompt", output_key: str = "generated_instruction", num_few_shot: int = 3, num_generate: int = 10, seed: int = 42) -> DataFrame:
    """num_generate new rows, each from a prompt with num_few_shot examples of df. Examples are drawn by hash: a top-k of n x k rows, whatever df's size."""
    require(df, input_key)
    need = num_few_shot * num_generate
    shots = [r[0] for r in df.filter(F.col(input_key).isNotNull()).select(input_key).orderBy(F.xxhash64(input_key, F.lit(seed)), input_key).limit(need).collect()]
    rows = [(i, "\n".join(shots[(i * num_few_shot + k) % len(shots)] for k in range(num_few_shot)) if shots else "") for i in range(num_generate)]
    new = df.sparkSession.createDataFrame(rows, "id int, examples string")
    return ask(new, "Write a new task of this kind.\n{examples}\n{id}", output_key, reply).select(output_key)


@register("chunked_prompted_generator")
def chunked_prompted(df: DataFrame, key: str, text: str, reply: Reply, output: str = "generated_content", max_chars: int = 128_000, separator: str = "\n") -> DataFrame:
    """The responses to the parts of each text, joined in order. A text is cut in halves until every part has at most max_chars characters."""
    require(df, key, text)
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    halvings = F.greatest(F.ceil(F.log2(F.greatest(n, F.lit(1)) / F.lit(float(max_chars)))), F.lit(0)).cast("int")
    size = F.greatest(F.ceil(n / F.pow(F.lit(2.0), halvings)).cast("int"), F.lit(1))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / F.col("_size")).cast("int") - 1, F.lit(0))), lambda i: F.substring(F.coalesce(F.col(text), F.lit("")), i * F.col("_size") + 1, F.col("_size")))
    each = df.select(key, text, size.alias("_size")).select(key, F.posexplode(parts).alias("_i", "_part"))
    got = ask(each, F.col("_part"), "_r", reply).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_i", "_r"))).alias("_rs"))
    return df.join(got.select(key, F.array_join(F.col("_rs._r"), separator).alias(output)), key, "left")


@register("text2qa_generator")
def text2qa(df: DataFrame, reply: Reply, answer: Reply | None = None, input_key: str = "text", question_num: int = 1) -> DataFrame:
    """Up to question_num rows a text: a prompt from the model's JSON list, then a question and an answer from `Q:` and `A:` of its second response."""
    require(df, input_key)
    asked = ask(df, template("List " + str(question_num) + " prompts for questions about the text as a JSON list.\n{t}", t=F.col(input_key)), RESPONSE, reply)
    rows = asked.withColumn("generated_prompt", F.explode(F.slice(F.coalesce(json_list(F.col(RESPONSE)), F.array().cast("array<string>")), 1, question_num)))
    got = ask(rows, template("{generated_prompt}\nAnswer as `Q: ...` and `A: ...`.\n{t}", t=F.col(input_key)), RESPONSE, answer or reply)
    q, a = (F.trim(F.regexp_extract(F.coalesce(F.col(RESPONSE), F.lit("")), p, 1)) for p in (r"(?s)Q:\s*(.*?)\s*(?=A:|$)", r"(?s)A:\s*(.*)"))
    return got.withColumns({"generated_question": q, "generated_answer": a}).drop(RESPONSE)


@register("text2qa_sample_evaluator")
def text2qa_grades(df: DataFrame, reply: Reply, question: str = "generated_question", answer: str = "generated_answer") -> DataFrame:
    """Four grades of each question and answer with their feedback: quality, alignment, verifiability, value."""
    require(df, question, answer)
    for name in ("question_quality", "answer_alignment", "answer_verifiability", "downstream_value"):
        got = ask(df, template(f"Grade the {name.replace('_', ' ')} as `**Grading**: n`, with feedback.\nQ: {{q}}\nA: {{a}}", q=F.col(question), a=F.col(answer)), RESPONSE, reply)
        df = got.withColumns({f"{name}_grades": F.coalesce(number(F.col(RESPONSE), r"\*\*Grading\*\*:\s*(\d+(?:\.\d+)?)"), F.lit(0.0)), f"{name}_feedbacks": F.trim(F.regexp_replace(F.coalesce(F.col(RESPONSE), F.lit("")), r"\*\*Grading\*\*:\s*\d+(?:\.\d+)?", ""))}).drop(RESPONSE)
    return df


@register("text2multihopqa_generator")
def text2multihopqa(df: DataFrame, key: str, reply: Reply, input_key: str = "cleaned_chunk", num_q: int = 5, least: int = 10) -> DataFrame:
    """(key, QA_pairs, QA_metadata): questions over neighbouring sentences (premise, intermediate, conclusion), read from JSON, each question once.

    Sentences of fewer than `least` characters don't count. Up to num_q triples a text are asked, spread evenly over it.
    """
    require(df, key, input_key)
    s = F.filter(F.transform(F.split(F.coalesce(F.col(input_key), F.lit("")), r"(?<=[.!?])\s+|(?<=[。！？])"), F.trim), lambda x: F.length(x) >= least)
    base = df.select(key, s.alias("_s")).withColumn("_n", F.size("_s") - 2).filter("_n > 0")
    at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(num_q - 1)), lambda i: F.floor(i * F.col("_n") / num_q).cast("int")))
    each = base.select(key, "_s", F.explode(at).alias("_i")).select(key, "_i", *[F.col("_s")[F.col("_i") + k].alias(n) for k, n in enumerate(("premise", "intermediate", "conclusion"))])
    got = ask(each, "Write a question that needs all three sentences, as JSON with question, answer, reasoning_steps and supporting_facts.\n1: {premise}\n2: {intermediate}\n3: {conclusion}", RESPONSE, reply)
    qa = got.withColumn("qa", F.from_json(unfenced_json(F.col(RESPONSE)), "struct<question:string,answer:string,reasoning_steps:array<string>,supporting_facts:array<string>>")).filter((F.length("qa.question") > 0) & (F.length("qa.answer") > 0))
    once = qa.groupBy(key, "qa.question").agg(F.min_by("qa", "_i").alias("qa"), F.min("_i").alias("_i"))
    hops = F.greatest(F.size(F.coalesce(F.col("qa.reasoning_steps"), F.array().cast("array<string>"))), F.lit(0))
    out = once.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_i", "qa", hops.alias("hops")))).alias("_q"))
    return df.select(key).join(out, key, "left").select(key, F.coalesce(F.col("_q.qa"), F.array().cast("array<struct<question:string,answer:string,reasoning_steps:array<string>,supporting_facts:array<string>>>")).alias("QA_pairs"), F.struct(F.coalesce(F.size("_q"), F.lit(0)).alias("n_pairs"), F.coalesce(F.aggregate("_q.hops", F.lit(0), lambda a, x: a + x), F.lit(0)).alias("n_steps")).alias("QA_metadata"))


@register("reasoning_question_generator")
def question_generator(df: DataFrame, reply: Reply, input_key: str = "instruction", num_prompts: int = 1, flag: str = "Synth_or_Input") -> DataFrame:
    """The rows of df, flagged input, and num_prompts (1 to 5) rewritten questions of each, flagged synth; empty responses go."""
    require(df, input_key)
    ways = ("other numbers", "another setting", "one more condition", "the question turned round", "a harder form")[: max(1, min(5, num_prompts))]
    new = df.withColumn("_way", F.explode(F.array(*map(F.lit, ways))))
    new = ask(new, template("Rewrite the problem with {_way}.\n{q}", q=F.col(input_key)), RESPONSE, reply).withColumn(input_key, F.trim(RESPONSE)).drop("_way", RESPONSE).filter(F.length(input_key) > 0)
    return df.withColumn(flag, F.lit("input")).unionByName(new.withColumn(flag, F.lit("synth")))


@register("reasoning_pseudo_answer_generator")
def pseudo_answers(df: DataFrame, key: str, reply: Reply, extract: Callable[[Column], Column], input_key: str = "instruction", max_times: int = 3) -> DataFrame:
    """The answer that most of max_times responses agree on (the first given one of equals), with its responses; rows without any answer go."""
    require(df, key, input_key)
    each = ask(df.select(key, input_key, F.explode(F.sequence(F.lit(1), F.lit(max_times))).alias("_round")), template("Solve the problem. Attempt {_round}.\n{q}", q=F.col(input_key)), RESPONSE, reply)
    votes = each.withColumn("_a", extract(F.col(RESPONSE))).filter(F.col("_a").isNotNull())
    by = votes.groupBy(key, "_a").agg(F.count("*").alias("_n"), F.min("_round").alias("_first"), F.sort_array(F.collect_list(F.struct("_round", RESPONSE))).alias("_rs"))
    best = by.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_first", "_a"))).alias("_all"), F.max_by(F.struct("_a", "_rs"), F.struct(F.col("_n"), -F.col("_first"))).alias("_b"))
    out = best.select(key, F.col("_all._a").alias("pseudo_answers"), F.col("_b._a").alias("pseudo_answer_value"), F.col(f"_b._rs.{RESPONSE}").alias("pseudo_solutions"), F.col(f"_b._rs.{RESPONSE}")[0].alias("pseudo_correct_solution_example"))
    return df.join(out, key)


@register("reasoning_answer_model_judge_filter")
def model_judge(df: DataFrame, reply: Reply, question: str = "question", answer: str = "answer", reference: str = "reference_answer", keep_all: bool = False) -> DataFrame:
    """answer_match_result: the model's judgement; false for an empty reference. Only true rows stay, unless keep_all."""
    require(df, question, answer, reference)
    got = ask(df, template("Does the answer agree with the reference? true or false.\nQ: {q}\nA: {a}\nR: {r}", q=F.col(question), a=F.col(answer), r=F.col(reference)), RESPONSE, reply)
    ok = (F.length(F.trim(F.coalesce(F.col(reference), F.lit("")))) > 0) & F.coalesce(F.lower(RESPONSE).rlike(r"\btrue\b") & ~F.lower(RESPONSE).rlike(r"\bfalse\b"), F.lit(False))
    got = got.withColumn("answer_match_result", ok).drop(RESPONSE)
    return got if keep_all else got.filter("answer_match_result")


@register("condor_refiner")
def condor_refine(df: DataFrame, reply: Reply, rewrite: Reply | None = None, instruction: str = "instruction", output: str = "output") -> DataFrame:
    """The output rewritten after the model's own critique of it."""
    require(df, instruction, output)
    got = ask(df, template("Criticise the answer.\nQ: {q}\nA: {a}", q=F.col(instruction), a=F.col(output)), "_critique", reply)
    new = ask(got, template("Rewrite the answer by the critique.\nQ: {q}\nA: {a}\nCritique: {_critique}", q=F.col(instruction), a=F.col(output)), RESPONSE, rewrite or reply)
    return new.withColumn(output, F.coalesce(F.nullif(F.trim(RESPONSE), F.lit("")), F.col(output))).drop("_critique", RESPONSE)


@register("condor_generator")
def condor_generate(spark: object, n: int, tags: dict[str, list[str]], reply: Reply, answer: Reply | None = None, seed: int = 42) -> DataFrame:
    """(instruction, output, difficulty): n draws of a topic and theme; each gives an [Easy], [Medium] and [Hard] question, and each question an answer."""
    flat = [(t, x) for t in sorted(tags) for x in tags[t]]
    pairs = F.array(*[F.struct(F.lit(t).alias("topic"), F.lit(x).alias("theme")) for t, x in flat])
    rows = spark.range(n).select("id", F.element_at(pairs, (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(len(flat))) + 1).cast("int")).alias("t")).select("id", "t.*")
    got = ask(rows, "Write three questions about {theme} in {topic}, marked [Easy], [Medium] and [Hard]. Draw {id}.", RESPONSE, reply)
    level = lambda k: F.struct(F.lit(k).alias("difficulty"), F.trim(F.regexp_extract(F.coalesce(F.col(RESPONSE), F.lit("")), rf"(?s)\[{k}\]\s*(.*?)(?=\[(?:Easy|Medium|Hard)\]|$)", 1)).alias("instruction"))
    each = got.select(F.explode(F.array(*map(level, ("Easy", "Medium", "Hard")))).alias("q")).select("q.*").filter(F.length("instruction") > 0)
    return ask(each, F.col("instruction"), "output", answer or reply).select("instruction", "output", "difficulty")
