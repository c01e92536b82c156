"""Queries of operator families over the test tables, with SQL that restates each in its own words.

Operators that ask a model get replies here that are expressions over the row (`stored`, or a function of the prompt), so that their prompts,
parsers, joins and filters are compared with SQL over whole tables; no model is needed for that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.operators import benchmarks, code, dialogues, documents, generation, language, quality_scores, refiners, relational, scores, text2sql
from siltworks.operators.serving import stored
from siltworks.runtime import spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pipeline_general").select("pair_id", "instruction", "output", "golden_answer", "source")


def _docs(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "documents").select("doc_id", "text", "lang", "source"))


def _code(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "code_input"))


_I, _O, _G = "coalesce(instruction, '')", "coalesce(output, '')", "coalesce(golden_answer, '')"
_FP = "FROM pipeline_general"


def _task(name: str, inputs: dict[str, str], reply: Callable, columns: dict[str, str], sql: str | None, query: str | None = None) -> None:
    """columns: name in the result -> expression over the operator's output."""
    def run(s: SparkSession, d: str) -> DataFrame:
        got = generation.run_task(_pairs(s, d), name, reply, inputs)
        return got.selectExpr("pair_id", *[f"{e} AS {c}" for c, e in columns.items()])

    QUERIES[f"op_{query or name}"] = (run, sql)


echo = lambda p: F.md5(p)  # noqa: E731  a response that tells every character of the prompt


def _echoed(name: str, inputs: dict[str, str], output: str, prompt: str) -> None:
    _task(name, inputs, echo, {"reply": output}, f"SELECT pair_id, md5({prompt}) AS reply {_FP}")


_echoed("prompted_generator", {"raw_content": "instruction"}, "generated_content", _I)
_echoed("prompted_refiner", {"raw_content": "instruction"}, "raw_content", f"'Rewrite the text. Give the text only.' || chr(10) || {_I}")
_echoed("phi4qa_generator", {"raw_content": "output"}, "generated_content", f"'Turn the passage into questions and answers.' || chr(10) || {_O}")
_echoed("speech2text_generator", {"raw_content": "source"}, "generated_content", "'Write down what is said in the recording.' || chr(10) || coalesce(source, '')")
_echoed("prompted_vqa_generator", {"raw_content": "source"}, "generated_content", "'Describe the picture.' || chr(10) || coalesce(source, '')")
_echoed("code_code_to_instruction_generator", {"code": "output"}, "generated_instruction", f"'State the task that this code solves.' || chr(10) || {_O}")
_echoed("code_enhancement_instruction_generator", {"messages": "instruction"}, "generated_instruction", f"'State the task more fully and more exactly.' || chr(10) || {_I}")
_echoed("scenario_extract_generator", {"chat": "output"}, "scenario", f"'Describe the scenario of this conversation.' || chr(10) || {_O}")
_echoed("scenario_expand_generator", {"scenario": "output"}, "modified_scenario", f"'Change the scenario into a new one of the same kind.' || chr(10) || {_O}")
_echoed("atom_task_generator", {"scenario": "output"}, "atom_task", f"'State one small task of this scenario.' || chr(10) || {_O}")
_echoed("function_generator", {"composition_task": "instruction", "sub_tasks": "output"}, "functions", f"'Specify the functions that these tasks need, as JSON.' || chr(10) || 'Whole: ' || {_I} || chr(10) || 'Parts: ' || {_O}")
_echoed("reasoning_answer_generator", {}, "generated_cot", f"'Solve the problem step by step; put the answer in a box.' || chr(10) || {_I}")
_echoed("reasoning_question_solvable_sample_evaluator", {}, "solvable", f"'Can this problem be solved as it is stated?' || chr(10) || {_I}")
_echoed("reasoning_question_fusion_generator", {"problem_1": "instruction", "problem_2": "output"}, "fused", f"'Fuse the two problems into one.' || chr(10) || '1: ' || {_I} || chr(10) || '2: ' || {_O}")

_N = "try_cast(nullif(regexp_extract({c}, '(\\d+)', 1), '') AS INTEGER)"
_task("prompted_evaluator", {"raw_content": "output"}, stored("golden_answer"), {"eval": "eval"}, f"SELECT pair_id, CASE WHEN {_N.format(c=_G)} BETWEEN 1 AND 5 THEN {_N.format(c=_G)} ELSE 0 END AS eval {_FP}")
_task("prompted_filter", {"raw_content": "output"}, stored("golden_answer"), {"eval": "eval"}, f"SELECT pair_id, {_N.format(c=_G)} AS eval {_FP} WHERE {_N.format(c=_G)} BETWEEN 1 AND 5")
_task("llm_language_filter", {"raw_content": "output"}, lambda p: F.when(F.length(p) % 3 == 0, " EN ").otherwise("de"), {"label": "language_label"}, f"SELECT pair_id, 'en' AS label {_FP} WHERE length('Name the language of the text by its two-letter code only.' || chr(10) || {_O}) % 3 = 0")
_task("meta_sample_evaluator", {"raw_content": "output"}, lambda p: F.when(F.length("instruction") % 2 == 0, F.concat(F.lit("Scores: [1, 2, 3.5, 4, 5, "), F.length("instruction") % 5, F.lit("]"))).otherwise("[1, 2]"), {"total": "aggregate(MetaScores, 0D, (a, x) -> a + coalesce(nullif(x, double('NaN')), -1D))"}, f"SELECT pair_id, CASE WHEN length(instruction) % 2 = 0 THEN 15.5 + length(instruction) % 5 ELSE -6 END AS total {_FP}")
_scored = lambda p: F.when(F.length("instruction") % 7 > 0, F.concat(F.lit("Score: "), F.length("instruction") % 12, F.lit("\nFeedback: "), F.col("source"))).otherwise("no idea")
_S = "CASE WHEN length(instruction) % 7 > 0 AND source IS NOT NULL THEN length(instruction) % 12 ELSE 0 END"
_task("code_quality_sample_evaluator", {"code": "output"}, _scored, {"score": "quality_score", "feedback": "coalesce(quality_feedback, '')"}, f"SELECT pair_id, {_S} AS score, CASE WHEN length(instruction) % 7 > 0 AND source IS NOT NULL THEN trim(source) ELSE '' END AS feedback {_FP}")
_task("code_quality_score_filter", {"code": "output"}, _scored, {"score": "quality_score"}, f"SELECT pair_id, {_S} AS score {_FP} WHERE {_S} = 0 OR {_S} BETWEEN 7 AND 10")
_task("code_instruction_to_code_generator", {}, stored("output"), {"code": "generated_code"}, f"SELECT pair_id, coalesce(nullif(regexp_extract(output, '(?s)```\\w*[ \\t]*\\n(.*?)```', 1), ''), output) AS code {_FP}")
_json = lambda p: F.when(F.length("instruction") % 3 > 0, F.concat(F.lit('```json\n{"score": '), F.length("instruction") % 11, F.lit("}\n```"))).otherwise(F.lit("none"))
_task("func_call_conversation_sample_evaluator", {"conversations": "output"}, _json, {"score": "score"}, f"SELECT pair_id, CASE WHEN length(instruction) % 3 > 0 THEN CAST(length(instruction) % 11 AS DOUBLE) ELSE 0.0 END AS score {_FP}")
_task("composition_task_filter", {"composition_task": "instruction", "sub_tasks": "output"}, lambda p: F.when(F.length(p) % 2 == 0, "so <ans> Yes </ans>").otherwise("<ans>no</ans>"), {"label": "runable_label"}, f"SELECT pair_id, 1 AS label {_FP} WHERE length('Can the whole be done by its parts? Answer <ans>yes</ans> or <ans>no</ans>.' || chr(10) || 'Whole: ' || {_I} || chr(10) || 'Parts: ' || {_O}) % 2 = 0")
_parts = lambda p: F.concat(F.lit("### Parallel Task\np"), F.col("pair_id"), F.lit("\n### Subsequent Task: s"), F.col("pair_id"), F.lit("\n\n### Composition Task\nc\nd"), F.col("pair_id"))
_task("sequential_task_generator", {"task": "instruction"}, _parts, {"next": "subsequent_task", "whole": "composition_task"}, f"SELECT pair_id, 's' || pair_id AS next, 'c' || chr(10) || 'd' || pair_id AS whole {_FP}")
_task("para_seq_task_generator", {"task": "instruction"}, _parts, {"beside": "parallel_task", "next": "subsequent_task", "whole": "composition_task"}, f"SELECT pair_id, 'p' || pair_id AS beside, 's' || pair_id AS next, 'c' || chr(10) || 'd' || pair_id AS whole {_FP}")
_task("kbc_text_cleaner", {"raw_chunk": "output"}, lambda p: F.when(F.length("instruction") % 2 == 0, F.concat(F.lit("x <cleaned_start> "), F.col("source"), F.lit(" <cleaned_end> y"))).otherwise(F.concat(F.lit(" "), F.col("source"))), {"clean": "cleaned_chunk"}, f"SELECT pair_id, trim(source, ' ') AS clean {_FP}")
_task("reasoning_question_difficulty_sample_evaluator", {}, lambda p: F.concat(F.lit("so **Rating: "), F.length("instruction") / 4.0), {"score": "difficulty_score"}, f"SELECT pair_id, CASE WHEN instruction IS NULL THEN -1.0 ELSE length(instruction) / 4 END AS score {_FP}")
_task("reasoning_question_filter", {"math_problem": "instruction"}, lambda p: F.when(F.length("instruction") % 3 == 0, F.lit('{"judgement_test": true}')).when(F.length("instruction") % 3 == 1, F.lit('text "judgement_test": "True" text')).otherwise('{"judgement_test": false}'), {"n": "length(instruction)"}, f"SELECT pair_id, length(instruction) AS n {_FP} WHERE length(instruction) % 3 < 2")
_task("alpagasus_sample_evaluator", {"input": "source"}, stored("golden_answer"), {"score": "AlpagasusScore"}, f"SELECT pair_id, try_cast(nullif(regexp_extract({_G}, '^\\s*([^\\s,;]+)', 1), '') AS DOUBLE) AS score {_FP}")
_task("alpagasus_filter", {"input": "source"}, lambda p: F.concat(F.length("instruction") % 7, F.lit(" because")), {"score": "AlpagasusScore"}, f"SELECT pair_id, CAST(length(instruction) % 7 AS DOUBLE) AS score {_FP} WHERE length(instruction) % 7 BETWEEN 3 AND 5")
_task("treeinstruct_sample_evaluator", {}, lambda p: F.concat(F.length("instruction") % 19, F.lit(" nodes")), {"score": "TreeinstructScore"}, f"SELECT pair_id, CAST(length(instruction) % 19 AS DOUBLE) AS score {_FP}")
_task("treeinstruct_filter", {}, lambda p: F.concat(F.length("instruction") % 19, F.lit(" nodes")), {"score": "TreeinstructScore"}, f"SELECT pair_id, CAST(length(instruction) % 19 AS DOUBLE) AS score {_FP} WHERE length(instruction) % 19 >= 7")
_task("text2sql_correspondence_filter", {"question": "instruction", "evidence": "source", "SQL": "output"}, lambda p: F.when(F.length("instruction") % 2 == 0, "```\nYes, it does\n```").otherwise("no"), {"n": "length(instruction)"}, f"SELECT pair_id, length(instruction) AS n {_FP} WHERE length(instruction) % 2 = 0")
_task("extract_smiles_from_text_generator", {"text": "output", "abbreviations": "source"}, lambda p: F.concat(F.lit('found: [{"abbreviation": "A'), F.col("pair_id"), F.lit('", "smiles": "CC"}, {"abbreviation": "B"}]')), {"n": "size(synth_smiles)", "first": "synth_smiles[0].abbreviation"}, f"SELECT pair_id, 2 AS n, 'A' || pair_id AS first {_FP}")


def _put(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[f"op_{name}"] = (query, sql)


# --- several calls a row

_put("text2qa_generator", lambda s, d: generation.text2qa(_pairs(s, d), lambda p: F.concat(F.lit('["one '), F.col("pair_id"), F.lit('", "two"]')), lambda p: F.concat(F.lit("Q: "), F.col("generated_prompt"), F.lit("?\nA: yes")), "output", 2).select("pair_id", "generated_prompt", "generated_question", "generated_answer"), f"SELECT pair_id, g AS generated_prompt, g || '?' AS generated_question, 'yes' AS generated_answer FROM (SELECT pair_id, unnest(['one ' || pair_id, 'two']) AS g {_FP})")
_put("text2qa_sample_evaluator", lambda s, d: generation.text2qa_grades(_pairs(s, d), lambda p: F.concat(F.lit("**Grading**: "), F.length("instruction") % 6, F.lit(" fine")), "instruction", "output").select("pair_id", "question_quality_grades", "answer_alignment_grades", "downstream_value_feedbacks"), f"SELECT pair_id, coalesce(CAST(length(instruction) % 6 AS DOUBLE), 0.0) AS question_quality_grades, coalesce(CAST(length(instruction) % 6 AS DOUBLE), 0.0) AS answer_alignment_grades, CASE WHEN instruction IS NULL THEN '' ELSE 'fine' END AS downstream_value_feedbacks {_FP}")
_put("reasoning_question_generator", lambda s, d: generation.question_generator(_pairs(s, d).select("pair_id", "instruction"), lambda p: F.when(F.col("pair_id") % 2 == 0, F.concat(F.lit("new "), F.col("pair_id"))), num_prompts=2), f"SELECT pair_id, instruction, 'input' AS Synth_or_Input {_FP} UNION ALL SELECT pair_id, 'new ' || pair_id, 'synth' FROM (SELECT pair_id, unnest([1, 2]) {_FP} WHERE pair_id % 2 = 0)")
_put("reasoning_answer_model_judge_filter", lambda s, d: generation.model_judge(_pairs(s, d), lambda p: F.when(F.col("pair_id") % 3 == 0, "True.").when(F.col("pair_id") % 3 == 1, "not true but false").otherwise("false"), "instruction", "output", "golden_answer").select("pair_id"), f"SELECT pair_id {_FP} WHERE pair_id % 3 = 0 AND trim({_G}, ' ') <> ''")
_put("condor_refiner", lambda s, d: generation.condor_refine(_pairs(s, d), echo, lambda p: F.when(F.col("pair_id") % 2 == 0, F.concat(F.lit("better: "), F.col("_critique"))).otherwise(" ")).select("pair_id", "output"), f"SELECT pair_id, CASE WHEN pair_id % 2 = 0 THEN 'better: ' || md5('Criticise the answer.' || chr(10) || 'Q: ' || {_I} || chr(10) || 'A: ' || {_O}) ELSE output END AS output {_FP}")
_put("chunked_prompted_generator", lambda s, d: generation.chunked_prompted(_docs(s, d), "doc_id", "text", lambda p: F.length(p).cast("string"), max_chars=500, separator="+").select("doc_id", "generated_content"), "SELECT doc_id, array_to_string(list_transform(range(0, greatest(CAST(ceil(n / w) AS BIGINT), 1)), lambda i: CAST(least(w, n - i * w) AS BIGINT)), '+') AS generated_content FROM (SELECT doc_id, n, greatest(CAST(ceil(n / pow(2, greatest(ceil(log2(greatest(n, 1) / 500)), 0))) AS BIGINT), 1) AS w FROM (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents))")
_put("embedding_generator", lambda s, d: generation.embedding_generator(_docs(s, d), _lengths, "text", "v").selectExpr("doc_id", "CAST(v[0] AS BIGINT) AS n"), "SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n FROM documents")
_put("format_str_prompted_generator", lambda s, d: generation.format_str_prompted(_pairs(s, d), "{source}: {instruction}", lambda p: F.when(F.col("pair_id") % 4 > 0, F.to_json(F.struct(F.length(p).alias("n")))).otherwise("broken"), "r", "n int").filter("r.n IS NOT NULL").selectExpr("pair_id", "r.n AS n"), f"SELECT pair_id, length(coalesce(source, '') || ': ' || {_I}) AS n {_FP} WHERE pair_id % 4 > 0")
_put("reasoning_pseudo_answer_generator", lambda s, d: generation.pseudo_answers(_pairs(s, d).select("pair_id", "instruction").distinct(), "pair_id", lambda p: F.concat(F.lit("Answer "), F.when(F.col("_round") == 2, F.lit(7)).otherwise(F.col("pair_id") % 5)), lambda r: F.regexp_extract(r, r"(\d+)", 1)).select("pair_id", "pseudo_answer_value", F.size("pseudo_solutions").alias("n")), f"SELECT pair_id, CAST(pair_id % 5 AS VARCHAR) AS pseudo_answer_value, 2 AS n FROM (SELECT DISTINCT pair_id, instruction {_FP})")
_put("text2multihopqa_generator", lambda s, d: generation.text2multihopqa(_docs(s, d), "doc_id", lambda p: F.to_json(F.struct(F.col("premise").alias("question"), F.col("conclusion").alias("answer"), F.array("intermediate").alias("reasoning_steps"))), "text").selectExpr("doc_id", "QA_metadata.n_pairs AS n_pairs", "QA_metadata.n_steps AS n_steps"))
_put("agenticrag_width_qa_generator", lambda s, d: dialogues.width_questions(_pairs(s, d).withColumnRenamed("instruction", "first").withColumnRenamed("output", "second"), echo, lambda p: F.when(p.startswith("Does"), (F.col("pair_id") % 2).cast("string")).otherwise("Score 0.5")).select("pair_id", "generated_width_task"), f"SELECT pair_id, md5('Ask both as one question.' || chr(10) || '1: ' || {_I} || chr(10) || '2: ' || {_O}) AS generated_width_task {_FP} WHERE pair_id % 2 = 1")
_put("agenticrag_depth_qa_generator", lambda s, d: dialogues.depth_questions(_pairs(s, d), "pair_id", lambda p: F.when(p.startswith("What"), "wider").otherwise(F.concat(F.lit("by "), F.length("depth_question"))), lambda p: F.when(p.startswith("Is"), F.when(F.col("pair_id") % 2 == 0, "Yes").otherwise("no")).otherwise((F.col("pair_id") % 3).cast("string")), "instruction", 1).select("pair_id", "depth_question"), f"SELECT pair_id, CASE WHEN pair_id % 2 = 0 AND instruction IS NOT NULL THEN 'by ' || length(instruction) ELSE instruction END AS depth_question {_FP} WHERE pair_id % 3 = 0")
_put("multi_turn_conversation_generator", lambda s, d: dialogues.multi_turn(_pairs(s, d).select("pair_id", "instruction", "source").distinct(), "pair_id", lambda p: F.lit("go"), lambda p: F.when(F.size("_c") > 2 * (F.col("pair_id") % 4), "<final> done").when(F.size("_c") == 1, "<func_call> f").otherwise("more"), lambda p: F.lit("result"), "instruction", "source").select("pair_id", F.size("conversations").alias("n")))
_put("code_sandbox_sample_evaluator", lambda s, d: dialogues.sandbox(table(s, d, "region").selectExpr("r_regionkey", "concat('assert ', r_regionkey, ' % 2 == 0') AS code"), "code").select("r_regionkey", "sandbox_status"), "SELECT r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS sandbox_status FROM region")


def _lengths(texts: list[str]) -> list[list[float]]:
    return [[float(len(t))] for t in texts]


# --- benchmarks and answers

_QA = "SELECT pair_id, output, golden_answer FROM pipeline_general"
_put("token_f1", lambda s, d: relational.qa_f1(_pairs(s, d), "output", "golden_answer").select("pair_id", F.round("F1Score", 6).alias("f1")), r"SELECT pair_id, CASE WHEN array_to_string(p, ' ') <> array_to_string(t, ' ') AND (array_to_string(p, ' ') IN ('yes', 'no', 'noanswer') OR array_to_string(t, ' ') IN ('yes', 'no', 'noanswer')) THEN 0.0 WHEN common = 0 THEN 0.0 ELSE round(2.0 * common / (len(p) + len(t)), 6) END AS f1 FROM (SELECT pair_id, p, t, coalesce(list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda x: x = w)), len(list_filter(t, lambda x: x = w))))), 0) AS common FROM (SELECT pair_id, list_filter(string_split_regex(regexp_replace(regexp_replace(translate(lower(coalesce(output, '')), '!\"#$%&()*+,-./:;<=>?@[\]^_`{|}~' || chr(39), ''), '(^|[^\p{L}\p{N}_])(a|an|the)($|[^\p{L}\p{N}_])', '\1 \3', 'g'), '(^|[^\p{L}\p{N}_])(a|an|the)($|[^\p{L}\p{N}_])', '\1 \3', 'g'), '[\s\x{3000}\x{a0}\x{85}\x{2000}-\x{200a}\x{202f}]+'), lambda x: x <> '') AS p, list_filter(string_split_regex(regexp_replace(regexp_replace(translate(lower(coalesce(golden_answer, '')), '!\"#$%&()*+,-./:;<=>?@[\]^_`{|}~' || chr(39), ''), '(^|[^\p{L}\p{N}_])(a|an|the)($|[^\p{L}\p{N}_])', '\1 \3', 'g'), '(^|[^\p{L}\p{N}_])(a|an|the)($|[^\p{L}\p{N}_])', '\1 \3', 'g'), '[\s\x{3000}\x{a0}\x{85}\x{2000}-\x{200a}\x{202f}]+'), lambda x: x <> '') AS t FROM pipeline_general))".replace('\\"', '"'))
_put("reasoning_answer_formatter_filter", lambda s, d: benchmarks.formatter_filter(_pairs(s, d), "output").select("pair_id"), f"SELECT pair_id {_FP}")
_put("reasoning_answer_groundtruth_filter", lambda s, d: benchmarks.groundtruth_filter(spread(_pairs(s, d)), "output", "golden_answer").select("pair_id"))
_put("reasoning_answer_pipeline_root_filter", lambda s, d: benchmarks.pipeline_root(spread(_pairs(s, d))).selectExpr("pair_id", "golden_answer", "has_gt"))
_put("bench_match", lambda s, d: scores.accuracy(scores.match_answers(table(s, d, "bench_eval_data"), "solution", "answer")))
_choice = lambda s, d: _pairs(s, d).withColumn("cs", F.array(*map(F.lit, "wxyz"))).withColumn("ans", F.when(F.col("pair_id") % 3 == 0, F.concat(F.lit("The answer is "), F.chr(F.col("pair_id") % 6 + 65))).when(F.col("pair_id") % 3 == 1, F.concat(F.lit("option_"), F.lit(" "), F.col("pair_id") % 6)).otherwise("none_of_them"))
_put("unified_bench_choice", lambda s, d: benchmarks.unified_bench(_choice(s, d).withColumn("label", F.lit(2)), "key3_q_choices_a", "ans", choices="cs", label="label").selectExpr("pair_id", "eval_valid", "coalesce(CAST(eval_pred AS INT), -1) AS said", "eval_score"), f"SELECT pair_id, i IS NOT NULL AS eval_valid, coalesce(i, -1) AS said, CASE WHEN i IS NOT NULL THEN CAST(i = 2 AS DOUBLE) END AS eval_score FROM (SELECT pair_id, CAST(CASE WHEN pair_id % 3 = 0 AND pair_id % 6 < 4 THEN pair_id % 6 WHEN pair_id % 3 = 1 AND pair_id % 6 < 4 THEN pair_id % 6 WHEN pair_id % 3 = 1 AND pair_id % 6 = 4 THEN 3 END AS INTEGER) AS i {_FP})")
_put("unified_bench_choices", lambda s, d: benchmarks.unified_bench(_pairs(s, d).withColumn("cs", F.array(*map(F.lit, "wxyz"))).withColumn("ls", F.array(F.lit(0), F.lit(2))).withColumn("ans", F.concat(F.lit("A, "), F.chr(F.col("pair_id") % 4 + 65))), "key3_q_choices_as", "ans", choices="cs", labels="ls").selectExpr("pair_id", "round(eval_score, 6) AS score"), f"SELECT pair_id, round(CASE pair_id % 4 WHEN 0 THEN 2.0 / 3 WHEN 2 THEN 1.0 ELSE 0.5 END, 6) AS score {_FP}")
_put("unified_bench_qa", lambda s, d: benchmarks.bench_summary(benchmarks.unified_bench(table(s, d, "bench_eval_data"), "key2_qa", "solution", target="answer")))
_put("unified_bench_answers", lambda s, d: benchmarks.unified_bench(spread(_pairs(s, d)).withColumn("all", F.array("golden_answer", "source")), "key2_q_ma", "golden_answer", targets="all").select("pair_id", "eval_valid", "eval_score"))
_put("unified_bench_text", lambda s, d: benchmarks.unified_bench(_docs(s, d), "key1_text_score", text="text", scorer=lambda c: F.length(c) / 10.0).select("doc_id", "eval_valid", "eval_score"), "SELECT doc_id, text IS NOT NULL AS eval_valid, length(text) / 10 AS eval_score FROM documents")
_put("unified_bench_preference", lambda s, d: benchmarks.unified_bench(_pairs(s, d), "key3_q_a_rejected", better="instruction", rejected="output", scorer=lambda c: F.length(c).cast("double")).select("pair_id", "eval_score"), f"SELECT pair_id, CAST(length(instruction) < length(output) AS DOUBLE) AS eval_score {_FP}")
_put("bench_answer_generator", lambda s, d: benchmarks.bench_answers(_choice(s, d), "key3_q_choices_as", echo, question="instruction", choices="cs").select("pair_id", "generated_ans"), f"SELECT pair_id, md5(chr(10) || {_I} || chr(10) || 'A. w' || chr(10) || 'B. x' || chr(10) || 'C. y' || chr(10) || 'D. z') AS generated_ans {_FP}")
_put("bench_dataset_evaluator_question", lambda s, d: benchmarks.bench_with_questions(_pairs(s, d), "output", "golden_answer", "instruction", lambda p: F.when(F.col("pair_id") % 3 == 0, "true, true").when(F.col("pair_id") % 3 == 1, "true, false").otherwise("?"), True).select("pair_id", "correct_ratio", "answer_match_result"), f"SELECT pair_id, CASE pair_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END AS correct_ratio, pair_id % 3 = 0 AS answer_match_result {_FP}")
_mol = "struct<abbreviation:string,smiles:string>"
_put("smiles_equivalence_dataset_evaluator", lambda s, d: benchmarks.smiles_equivalence(_pairs(s, d).select("pair_id", F.expr("array(named_struct('abbreviation', 'A', 'smiles', 'C C'), named_struct('abbreviation', 'B', 'smiles', 'N'))").alias("golden_label"), F.expr("array(named_struct('abbreviation', 'A', 'smiles', 'X'), named_struct('abbreviation', 'A', 'smiles', if(pair_id % 2 = 0, 'CC', 'CO')), named_struct('abbreviation', 'C', 'smiles', 'N'))").alias("synth_smiles"))).select("pair_id", "block_score", "block_total", "block_accuracy"), f"SELECT pair_id, CASE WHEN pair_id % 2 = 0 THEN 1 ELSE 0 END AS block_score, 2 AS block_total, CASE WHEN pair_id % 2 = 0 THEN 0.5 ELSE 0.0 END AS block_accuracy {_FP}")
_put("reasoning_question_category_sample_evaluator", lambda s, d: benchmarks.question_category(spread(_pairs(s, d)), lambda p: F.concat(F.lit('{"primary_category": "x", "secondary_category": "'), F.col("pair_id") % 9, F.lit("."), F.col("pair_id") % 3 + 1, F.lit('"}')), "instruction").select("pair_id", "primary_category", "secondary_category"))

# --- scores and their filters

_len = lambda c: F.length(c).cast("double")


def _score(name: str, scorer: Callable, sql_score: str, condition: str, inputs: tuple[str, ...] = ("output",)) -> None:
    out = quality_scores.SCORES[name].output
    _put(f"{name}_sample_evaluator", lambda s, d: quality_scores.evaluate(_pairs(s, d), name, scorer, inputs).select("pair_id", F.col(out).alias("score")), f"SELECT pair_id, {sql_score} AS score {_FP}")
    _put(f"{name}_filter", lambda s, d: quality_scores.range_filter(_pairs(s, d), name, scorer, inputs).select("pair_id"), f"SELECT pair_id FROM (SELECT pair_id, {sql_score} AS score {_FP}) WHERE {condition}")


_score("debertav3", lambda c: F.when(F.length(c) % 3 == 0, "High").when(F.length(c) % 3 == 1, "Medium").otherwise("Low"), "CASE WHEN output IS NULL THEN 'Low' WHEN length(output) % 3 = 0 THEN 'High' WHEN length(output) % 3 = 1 THEN 'Medium' ELSE 'Low' END", "score IN ('Medium', 'High')")
_score("fineweb_edu", lambda c: _len(c) / 100, "length(output) / 100", "score BETWEEN 2.5 AND 10000")
_score("pair_qual", lambda c: _len(c) - 50, "CAST(length(output) - 50 AS DOUBLE)", "score BETWEEN 0 AND 10000")
_score("textbook", lambda c: F.when(F.length(c) % 2 == 0, 1.0).otherwise(0.5), "CASE WHEN length(output) % 2 = 0 THEN 1.0 ELSE 0.5 END", "score BETWEEN 0.99 AND 1")
_score("deita_complexity", lambda i, o: quality_scores.softmax_level(F.array(*[F.lit(float(k)) * (F.length(i) % 3) for k in range(6)])), "round(list_sum(list_transform(range(0, 6), lambda k: (k + 1) * exp(k * (length(instruction) % 3)))) / list_sum(list_transform(range(0, 6), lambda k: exp(k * (length(instruction) % 3)))), 9)", "score BETWEEN 3 AND 5", ("instruction", "output"))
_score("deita_quality", lambda i, o: quality_scores.expected_level(F.array(*[F.lit(0.25)] * 4), (1, 2, 3, 4)) + _len(o) * 0, "CASE WHEN output IS NOT NULL THEN 2.5 END", "score BETWEEN 2.5 AND 10000", ("instruction", "output"))
_score("instag", lambda c: quality_scores.tag_count(F.when(F.length(c) % 3 == 0, '[{"tag": "a"}, {"tag": "b"}]').when(F.length(c) % 3 == 1, '{"tag": "a"}').otherwise("none")), "CASE WHEN instruction IS NULL THEN 0 WHEN length(instruction) % 3 = 0 THEN 2 WHEN length(instruction) % 3 = 1 THEN 1 ELSE 0 END", "score BETWEEN 0 AND 1", ("instruction",))
_score("rm", lambda i, o: _len(o) / 200, "length(output) / 200", "score BETWEEN 0.2 AND 0.8", ("instruction", "output"))
_score("perspective", lambda c: _len(c) / 300, "length(output) / 300", "score IS NULL OR score BETWEEN 0 AND 0.5")
_score("bert", lambda a, b: _len(a) / _len(b), "CASE WHEN length(golden_answer) > 0 THEN length(output) / length(golden_answer) END", "score BETWEEN 0 AND 1", ("output", "golden_answer"))
_put("deita_complexity_sample_evaluator", lambda s, d: quality_scores.evaluate(_pairs(s, d), "deita_complexity", lambda i, o: F.round(quality_scores.softmax_level(F.array(*[F.lit(float(k)) * (F.length(i) % 3) for k in range(6)])), 9), ("instruction", "output")).select("pair_id", F.col("DeitaComplexityScore").alias("score")), QUERIES["op_deita_complexity_sample_evaluator"][1])
_four = lambda c: F.struct(*[((F.length(c) + k) % 12).cast("double").alias(p) for k, (p, _, _) in enumerate(quality_scores.SCORES["qurating"].parts)])
_put("qurating_sample_evaluator", lambda s, d: quality_scores.evaluate(_pairs(s, d), "qurating", _four, ("output",)).select("pair_id", "writing_style", "educational_value"), f"SELECT pair_id, CAST(length(output) % 12 AS DOUBLE) AS writing_style, CAST((length(output) + 3) % 12 AS DOUBLE) AS educational_value {_FP}")
_put("qurating_filter", lambda s, d: quality_scores.range_filter(_pairs(s, d), "qurating", _four, ("output",)).select("pair_id", "writing_style_label"), f"SELECT pair_id, 1 AS writing_style_label {_FP} WHERE greatest(length(output) % 12, (length(output) + 1) % 12, (length(output) + 2) % 12, (length(output) + 3) % 12) <= 9")
def _pii_count() -> str:
    left, terms = "coalesce(text, '')", []
    for p in (r"[\w.+-]+@[\w-]+\.[\w.-]+", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", r"\b(?:\d[ -]?){13,16}\b", r"\b\d{3}-\d{2}-\d{4}\b", r"\+?\d{1,3}[ -]\(?\d{2,4}\)?(?:[ -]\d{2,4}){2,3}\b"):
        terms.append(f"len(regexp_extract_all({left}, '{p}'))")
        left = f"regexp_replace({left}, '{p}', ' ', 'g')"
    return "CAST(" + " + ".join(terms) + " AS DOUBLE)"


_PII_COUNT = _pii_count()
_put("presidio_sample_evaluator", lambda s, d: quality_scores.evaluate(_docs(s, d), "presidio", quality_scores.pii_count, ("text",)).select("doc_id", F.col("PresidioScore").alias("n")), f"SELECT doc_id, {_PII_COUNT} AS n FROM documents")
_put("presidio_filter", lambda s, d: quality_scores.range_filter(_docs(s, d), "presidio", quality_scores.pii_count, ("text",)).select("doc_id"), f"SELECT doc_id FROM documents WHERE {_PII_COUNT} BETWEEN 0 AND 5")
_put("task2vec_dataset_evaluator", lambda s, d: quality_scores.diversity(table(s, d, "embeddings"), "embedding"))


def _character_model(s: SparkSession, d: str) -> language.CharacterModel:
    return language.CharacterModel.fit([t for _, t in language.sample(table(s, d, "documents").withColumn("one", F.lit("x")), "one", "text", 200)])


def _language_model(s: SparkSession, d: str) -> language.LanguageModel:
    folded = table(s, d, "documents").withColumn("l", F.lower(F.substring(F.trim("lang"), 1, 2))).filter(F.col("l").isin("en", "de", "fr", "es", "pt", "ru", "zh", "ja"))
    return language.LanguageModel.fit(language.sample(folded, "l", "text", 100))


_put("perplexity_sample_evaluator", lambda s, d: quality_scores.evaluate(_docs(s, d), "perplexity", language.perplexities(_character_model(s, d)), ("text",)).select("doc_id", F.round("PerplexityScore", 4).alias("score")))
_put("perplexity_filter", lambda s, d: quality_scores.range_filter(_docs(s, d), "perplexity", language.perplexities(_character_model(s, d)), ("text",)).select("doc_id"))
_put("superfiltering_sample_evaluator", lambda s, d: quality_scores.evaluate(spread(_pairs(s, d)), "superfiltering", language.difficulties(_character_model(s, d))).select("pair_id", F.round("SuperfilteringScore", 4).alias("score")))
_put("superfiltering_filter", lambda s, d: quality_scores.range_filter(spread(_pairs(s, d)), "superfiltering", language.difficulties(_character_model(s, d))).select("pair_id"))
_put("language_filter", lambda s, d: language.language_filter(_docs(s, d), "text", ["de", "fr"], _language_model(s, d), most=1).select("doc_id"))
_put("langkit_sample_evaluator", lambda s, d: scores.readability_scores(_docs(s, d).select("doc_id", "text"), "text").drop("text"))
_put("langkit_filter", lambda s, d: scores.readability_filter(_docs(s, d).select("doc_id", "text"), "text").select("doc_id"))
_put("lexical_diversity_filter", lambda s, d: scores.lexical_diversity_filter(_docs(s, d).select("doc_id", "text"), "text").select("doc_id"))
_put("spelling_correction_refiner", lambda s, d: scores.spelling(_docs(s, d).select("doc_id", "text"), "text", {"people": 9, "water": 8, "river": 7, "which": 6}))
_put("ner_refiner", lambda s, d: refiners.ner(_docs(s, d).select("doc_id", "text"), "text", _capitals), r"SELECT doc_id, CASE WHEN text IS NOT NULL THEN replace(text, 'The', '[WORD]') END AS text FROM documents")


def _capitals(texts: list[str]) -> list[list[tuple[str, str]]]:
    return [[("The", "WORD")] if "The" in t else [] for t in texts]


# --- documents and questions

_Q = "'[{\"question\": \" q' || pair_id || '\", \"answer\": \"a\", \"extra\": 1}, {\"question\": \"\", \"answer\": \"b\"}, {\"question\": \"r\"}]'"
_put("qa_extractor", lambda s, d: documents.extract_qa(_pairs(s, d).selectExpr("if(pair_id % 2 = 0, " + _Q.replace("'", "\u0001").replace("\u0001", "'") + ", concat('{\"qa_pairs\": ', " + _Q + ", '}')) AS QA_pairs"), instruction="Answer."), f"SELECT 'Answer.' AS instruction, 'q' || pair_id AS input, 'a' AS output {_FP}")
_put("pandas_operator", lambda s, d: relational.compose(_pairs(s, d), [lambda x: x.filter("pair_id % 2 = 0"), lambda x: x.select("pair_id", F.upper("source").alias("source"))]), f"SELECT pair_id, upper(source) AS source {_FP} WHERE pair_id % 2 = 0")
_put("load_partition", lambda s, d: relational.merge_by_id([table(s, d, "nation"), table(s, d, "nation").filter("n_regionkey > 0").select("n_nationkey", F.lower("n_name").alias("n_name"))], "n_nationkey"), "SELECT n_nationkey, n_regionkey, lower(n_name) AS n_name FROM nation WHERE n_regionkey > 0")
_put("html_to_markdown", lambda s, d: documents.to_markdown(_docs(s, d).withColumn("page", F.lit("a/b.html")), "page", "text", "md").select("doc_id", "md"))
_layout = '[{"type": "text", "text": "Chapter 1", "bbox": [1], "page_idx": 0}, {"type": "list", "sub_type": "text", "list_items": ["one", "two"]}, {"type": "image", "img_path": "a/b.png", "image_caption": ["a", "fig"]}]'
_put("layout_to_llm_input_operator", lambda s, d: documents.flatten_layout(table(s, d, "nation").select("n_nationkey", F.lit(_layout).alias("l")), "n_nationkey", "l").select("n_nationkey", "id", "type", "text"), "SELECT n_nationkey, unnest([0, 1, 2, 3]) AS id, unnest(['text', 'text', 'text', 'image']) AS type, unnest(['Chapter 1', 'one', 'two', NULL]) AS text FROM nation")
_reply = "<chapter><title>0</title><qa_pair><label>1</label><question>1, 2,x,99</question><answer>yes</answer></qa_pair><qa_pair><label>2</label></qa_pair><qa_pair><label>3</label><solution>3</solution></qa_pair></chapter>"
_put("llm_output_parser", lambda s, d: documents.parse_llm_output(table(s, d, "nation").select("n_nationkey", F.lit(_reply).alias("r")), "n_nationkey", "r", documents.flatten_layout(table(s, d, "nation").select("n_nationkey", F.lit(_layout).alias("l")), "n_nationkey", "l")), "SELECT n_nationkey, unnest([1, 2]) AS n, 'Chapter 1' AS chapter_title, unnest(['1', '3']) AS label, unnest(['one' || chr(10) || 'two', '']) AS question, unnest(['yes', '']) AS answer, unnest(['', '![a fig](images/b.png)']) AS solution FROM nation")
_put("qa_merger", lambda s, d: documents.merge_qa(_pairs(s, d).groupBy("pair_id").agg(F.max("source").alias("source")).selectExpr("'n' AS name", "pair_id AS ord", "'' AS chapter_title", "cast(pair_id div 2 + 1 AS string) AS label", "if(pair_id % 2 = 0, concat('q', pair_id), '') AS question", "if(pair_id % 2 = 1, concat('a', pair_id), '') AS answer", "'' AS solution"), "name", "ord").select("label", "question", "answer"), "SELECT x.pair_id // 2 + 1 AS label, 'q' || x.pair_id AS question, 'a' || y.pair_id AS answer FROM (SELECT DISTINCT pair_id FROM pipeline_general) x JOIN (SELECT DISTINCT pair_id FROM pipeline_general) y ON y.pair_id = x.pair_id + 1 WHERE x.pair_id % 2 = 0")
_put("sentence_chunks", lambda s, d: documents.sentence_chunks(_docs(s, d), "doc_id", "text", 60))
_put("recursive_chunks", lambda s, d: documents.recursive_chunks(_docs(s, d), "doc_id", "text", 400))

# --- repetition, code, SQL texts

_HAN = "regexp_matches(x, '[\\x{4e00}-\\x{9fff}]')"
_put("answer_ngram_filter", lambda s, d: relational.answer_ngram(_pairs(s, d), "instruction", "output").select("pair_id"), r"SELECT pair_id FROM (SELECT pair_id, CASE WHEN regexp_matches(x, '[\x{4e00}-\x{9fff}]') THEN list_transform(range(1, greatest(length(c) - 3, 1)), lambda i: substr(c, i, 5)) ELSE list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END AS g FROM (SELECT pair_id, x, regexp_replace(x, '[^\x{4e00}-\x{9fff}0-9a-z]', '', 'g') AS c, list_filter(string_split_regex(regexp_replace(x, '[^\p{L}\p{N}_\s\x{3000}\x{a0}\x{85}\x{2000}-\x{200a}\x{202f}]', ' ', 'g'), '[\s\x{3000}\x{a0}\x{85}\x{2000}-\x{200a}\x{202f}]+'), lambda v: v <> '') AS w FROM (SELECT pair_id, lower(coalesce(instruction, '') || ' ' || coalesce(output, '')) AS x FROM pipeline_general))) WHERE len(g) > 0 AND len(list_distinct(g)) / len(g) BETWEEN 0.1 AND 1.0")
_put("ngram_characters", lambda s, d: spread(_pairs(s, d)).select("pair_id", F.round(_char_score(F.col("output")), 6).alias("score")), r"SELECT pair_id, round(CASE WHEN length(c) < 5 THEN 0.0 ELSE len(list_distinct(g)) / len(g) END, 6) AS score FROM (SELECT pair_id, c, list_transform(range(1, greatest(length(c) - 3, 1)), lambda i: substr(c, i, 5)) AS g FROM (SELECT pair_id, regexp_replace(lower(coalesce(output, '')), '[^\p{L}\p{N}_\s\x{3000}\x{a0}\x{85}\x{2000}-\x{200a}\x{202f}]', '', 'g') AS c FROM pipeline_general))")


def _char_score(c):
    from siltworks.operators.rule_filters import ngram_score

    return ngram_score(c, 5, False)


_SQLTEXT = "lower(coalesce(text, ''))"
_HAS = lambda *w: "(CASE WHEN " + " OR ".join(f"contains(q, '{x}')" for x in w) + " THEN 1 ELSE 0 END)"
_OCC = lambda w: f"((length(q) - length(replace(q, '{w}', ''))) / {len(w)})"
_put("sql_component_classifier", lambda s, d: text2sql.component_classifier(_docs(s, d).select("doc_id", F.col("text").alias("SQL"))).select("doc_id", text2sql.sql_difficulty(F.col("SQL")).cast("int").alias("score"), F.col("sql_component_difficulty").alias("label")), f"SELECT doc_id, CAST(score AS INTEGER) AS score, CASE WHEN score <= 2 THEN 'easy' WHEN score <= 4 THEN 'medium' WHEN score <= 6 THEN 'hard' ELSE 'extra' END AS label FROM (SELECT doc_id, (CASE WHEN regexp_matches(q, '\\( *select') THEN 2 ELSE 0 END) + {_OCC(' join ')} + (CASE WHEN contains(q, ',') AND contains(q, 'from') THEN 1 ELSE 0 END) + (CASE WHEN {_OCC(' and ')} + {_OCC(' or ')} >= 2 THEN 1 ELSE 0 END) + {_HAS('in', 'exists', 'like')} + {_HAS('group by')} + {_HAS('having')} + {_HAS('cast', 'round', 'substring', 'date', 'coalesce')} + {_HAS('order by')} + {_HAS('limit')} + 2 * {_HAS('union', 'intersect', 'except')} + (CASE WHEN contains(regexp_extract(q, '(?s)select\\s+(distinct\\s+)?(.+?)\\s+from', 2), ',') THEN 1 ELSE 0 END) AS score FROM (SELECT doc_id, {_SQLTEXT} AS q FROM documents))")
_put("text2sql_prompt_generator", lambda s, d: text2sql.prompts(_pairs(s, d).withColumn("db_id", F.when(F.col("pair_id") % 2 == 0, "a").otherwise("b")), text2sql.schemas(s, {"a": {"t": [("x", "int"), ("y", "text")]}}), "instruction", evidence="source").select("pair_id", F.md5("prompt").alias("p")), f"SELECT pair_id, md5('Schema:' || chr(10) || CASE WHEN pair_id % 2 = 0 THEN 'CREATE TABLE t (x int, y text);' ELSE '' END || chr(10) || 'Evidence: ' || coalesce(source, '') || chr(10) || 'Question: ' || {_I}) AS p {_FP}")


def _sql_rows(s: SparkSession, d: str) -> tuple[DataFrame, text2sql.SparkEngine]:
    for t in ("region", "nation"):
        table(s, d, t).createOrReplaceTempView(f"tpch_{t}")
    rows = [(1, "tpch", "SELECT r_name FROM tpch_region", ["```sql\nSELECT r_name FROM tpch_region\n```", "x ```sql\nSELECT upper(r_name) AS r FROM tpch_region\n```", "no"]), (2, "tpch", "-- c\nWITH x AS (SELECT 1 AS a) SELECT a FROM x", ["```sql\nSELECT 1\n```"]), (3, "tpch", "SELECT nothing FROM nowhere", ["```sql\nSELECT nothing\n```"]), (4, "tpch", "DROP TABLE tpch_region", []), (5, "tpch", None, None)]
    return s.createDataFrame(rows, "id int, db_id string, SQL string, cot_responses array<string>"), text2sql.SparkEngine(s)


_put("sql_executability_filter", lambda s, d: (lambda r: text2sql.executability_filter(*r).select("id"))(_sql_rows(s, d)), "SELECT unnest([1, 2]) AS id")
_put("sql_execution_filter", lambda s, d: (lambda r: text2sql.execution_filter(*r).select("id"))(_sql_rows(s, d)), "SELECT unnest([1, 2]) AS id")
_put("text2sql_cot_voting_generator", lambda s, d: (lambda r: text2sql.vote(r[0], "id", r[1]).select("id", "SQL"))(_sql_rows(s, d)), "SELECT unnest([1, 2]) AS id, unnest(['SELECT r_name FROM tpch_region', 'SELECT 1']) AS SQL")
_put("sql_execution_classifier", lambda s, d: (lambda r: text2sql.execution_classifier(r[0].filter("SQL IS NOT NULL").withColumn("prompt", F.lit("p")), "id", r[1], lambda p: F.when(F.col("id") == 1, F.lit("```sql\nSELECT r_name FROM tpch_region\n```")).otherwise("none"), 3).selectExpr("id", "sql_execution_difficulty AS d"))(_sql_rows(s, d)), "SELECT unnest([1, 2, 3, 4]) AS id, unnest(['hard', 'extra', 'gold error', 'gold error']) AS d")

_A = "CodeAutoGenerated"
_put("code_auto_generated_filter", lambda s, d: code._filter("AutoGenerated")(_code(s, d)).select("id").distinct(), "SELECT DISTINCT id FROM code_input WHERE NOT regexp_matches(lower(array_to_string(list_slice(coalesce(lines, []), 1, 5), chr(10))), 'auto-generated|autogenerated|automatically generated|generated automatically|this file is generated')")
_put("code_auto_generated_sample_evaluator", lambda s, d: code.auto_generated(_code(s, d)).selectExpr("id", f"CAST({_A}MarkerCount AS INT) AS n", f"{_A}Score AS score").distinct(), "SELECT DISTINCT id, n, CASE WHEN n > 0 THEN 0.0 ELSE 1.0 END AS score FROM (SELECT id, " + " + ".join(f"(CASE WHEN contains(h, '{m}') THEN 1 ELSE 0 END)" for m in ("auto-generated", "autogenerated", "automatically generated", "generated automatically", "this file is generated")) + " AS n FROM (SELECT id, lower(array_to_string(list_slice(coalesce(lines, []), 1, 5), chr(10))) AS h FROM code_input))")
_RATIOS = r"length(array_to_string(regexp_extract_all(coalesce(text, ''), '[a-zA-Z0-9+/=\n]{64,}'), '')) / greatest(length(coalesce(text, '')), 1) AS b, length(array_to_string(regexp_extract_all(coalesce(text, ''), '(?:\b(?:0x|\\x)?[0-9a-fA-F]{2}(?:,|\b\s*)){8,}'), '')) / greatest(length(coalesce(text, '')), 1) AS h, length(array_to_string(regexp_extract_all(coalesce(text, ''), '(?:\\u[0-9a-fA-F]{4}){8,}'), '')) / greatest(length(coalesce(text, '')), 1) AS u"
_put("code_encoded_data_sample_evaluator", lambda s, d: code.encoded(_code(s, d)).selectExpr("id", "round(CodeEncodedDataBase64Ratio, 6) AS base64", "round(CodeEncodedDataUnicodeRatio, 6) AS uni").distinct(), f"SELECT DISTINCT id, round(b, 6) AS base64, round(u, 6) AS uni FROM (SELECT id, {_RATIOS} FROM code_input)")
_put("code_encoded_data_filter", lambda s, d: code._filter("EncodedData")(_code(s, d)).select("id").distinct(), f"SELECT DISTINCT id FROM (SELECT id, {_RATIOS} FROM code_input) WHERE greatest(b, h, u) <= 0.5")
_put("code_length_sample_filter", lambda s, d: code._filter("Length")(_code(s, d)).select("id").distinct(), "SELECT DISTINCT id FROM (SELECT id, language, len(coalesce(lines, [])) AS n, coalesce(list_avg(list_transform(lines, lambda x: length(x))), 0) AS mean, coalesce(list_max(list_transform(lines, lambda x: length(x))), 0) AS top FROM code_input) WHERE n <= 100000 AND CASE WHEN coalesce(language, '') IN ('HTML', 'JSON', 'Markdown', 'Roff', 'Roff Manpage', 'SMT', 'TeX', 'Text', 'XML') THEN top <= 100000 ELSE mean <= 100 AND top <= 1000 END")
_SHARE = lambda cls: f"length(regexp_replace(coalesce(text, ''), '{cls}', '', 'g')) / greatest(length(coalesce(text, '')), 1)"
_put("code_text_composition_sample_evaluator", lambda s, d: code.composition(_code(s, d)).selectExpr("id", "round(CodeTextCompositionAlphaRatio, 6) AS alpha", "round(CodeTextCompositionAlnumRatio, 6) AS alnum", "CodeTextCompositionScore AS score").distinct(), rf"SELECT DISTINCT id, round(a, 6) AS alpha, round(n, 6) AS alnum, CASE WHEN (CASE WHEN language IN ('Motorola 68K Assembly', 'WebAssembly') THEN n ELSE a END) < 0.25 THEN 0.0 ELSE 1.0 END AS score FROM (SELECT id, language, {_SHARE(chr(92) + 'P{L}')} AS a, {_SHARE('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]')} AS n FROM code_input)")
_put("code_text_composition_filter", lambda s, d: code._filter("TextComposition")(_code(s, d)).select("id").distinct(), rf"SELECT DISTINCT id FROM (SELECT id, language, {_SHARE(chr(92) + 'P{L}')} AS a, {_SHARE('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]')} AS n FROM code_input) WHERE (CASE WHEN language IN ('Motorola 68K Assembly', 'WebAssembly') THEN n ELSE a END) >= 0.25")
_put("code_file_type_content_filter", lambda s, d: code.type_filter(_code(s, d)).select("id").distinct(), "SELECT DISTINCT id FROM code_input WHERE CASE WHEN lower(coalesce(filetype, '')) IN ('text', 'json', 'yaml', 'web ontology language', 'graphviz', 'dot') THEN coalesce(line_count <= 512, true) WHEN lower(coalesce(filetype, '')) = 'html' THEN coalesce(visible_text_length >= 100 AND visible_text_length / greatest(total_code_length, 1) >= 0.2, true) ELSE true END")
_DQ = "CodeDocumentQuality"
_DUP = lambda l: f"CASE WHEN len({l}) = 0 THEN 0.0 ELSE coalesce(list_sum(list_filter(map_values(list_histogram({l})), lambda v: v > 1)), 0) / len({l}) END"
_put("code_document_quality_sample_evaluator", lambda s, d: code.document_quality(_code(s, d)).selectExpr("id", f"{_DQ}CharCount AS chars", f"{_DQ}WordCount AS words", f"round({_DQ}DuplicateLinesRatio, 6) AS dup_lines", f"round({_DQ}CurlyBracketRatio, 6) AS curly", f"round({_DQ}AllCapsRatio, 6) AS caps", f"round({_DQ}Entropy, 5) AS entropy", f"round({_DQ}Duplicate_2Gram_RatioRatio, 6) AS dup2", f"{_DQ}Score AS score").distinct(), rf"SELECT DISTINCT id, CAST(length(t) AS INTEGER) AS chars, CAST(len(w) AS INTEGER) AS words, round({_DUP('l')}, 6) AS dup_lines, round(CASE WHEN length(t) > 0 THEN len(regexp_extract_all(t, '[{{}}]')) / length(t) ELSE 0.0 END, 6) AS curly, round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x))) / len(w) ELSE 0.0 END, 6) AS caps, round(coalesce(list_sum(list_transform(map_values(list_histogram(w)), lambda c: -(c / len(w)) * log2(c / len(w)))), 0.0), 5) AS entropy, round({_DUP('g')}, 6) AS dup2, CASE WHEN length(t) BETWEEN 1 AND 100000 AND len(w) BETWEEN 1 AND 100000 THEN 1.0 ELSE 0.0 END AS score FROM (SELECT id, t, w, l, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM (SELECT id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}_]+') AS w, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c]'), lambda x: regexp_replace(x, '^[\s\x{{a0}}\x{{3000}}]+|[\s\x{{a0}}\x{{3000}}]+$', '', 'g')), lambda x: x <> '') AS l FROM code_input))")
_put("code_document_quality_filter", lambda s, d: code._filter("DocumentQuality")(_code(s, d)).select("id").distinct(), r"SELECT DISTINCT id FROM code_input WHERE length(coalesce(text, '')) BETWEEN 1 AND 100000 AND len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+')) BETWEEN 1 AND 100000")
_put("code_generic_score_filter", lambda s, d: _generic(_docs(s, d).withColumn("n", F.length("text"))).select("doc_id"), "SELECT doc_id FROM documents WHERE length(text) >= 400")


def _generic(df: DataFrame) -> DataFrame:
    from siltworks.operators.rule_filters import generic_score_filter

    return generic_score_filter(df, "n", score_threshold=400)


_put("answer_token_length_filter", lambda s, d: relational.answer_length(_pairs(s, d), "output", 20).select("pair_id"), r"SELECT pair_id FROM pipeline_general WHERE len(list_filter(string_split_regex(coalesce(output, ''), '[\s\x{3000}\x{a0}\x{85}\x{2000}-\x{200a}\x{202f}]+'), lambda x: x <> '')) BETWEEN 1 AND 20")
_put("blocklist_table_filter", lambda s, d: _blocked(s, d).select("doc_id"), r"SELECT doc_id FROM documents, (SELECT list(lower(word)) AS b FROM common_words WHERE lang = 'en' AND word IS NOT NULL) WHERE coalesce(text, '') <> '' AND len(list_filter(string_split_regex(lower(text), '[\s\x{3000}\x{a0}\x{85}\x{2000}-\x{200a}\x{202f}]+'), lambda x: list_contains(b, x))) <= 5")


def _blocked(s: SparkSession, d: str) -> DataFrame:
    from siltworks.operators.rule_filters import blocklist_table

    return blocklist_table(_docs(s, d), "doc_id", "text", table(s, d, "common_words").filter("lang = 'en' AND word IS NOT NULL"), 5)
