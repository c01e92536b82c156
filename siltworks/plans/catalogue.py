"""Every query of the core library with its SQL counterpart, which is written for DuckDB and shares only fixed values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.operators import code, near_duplicates, relational, scores
from siltworks.operators.refiners import refine
from siltworks.operators.rule_filters import general_filter, keep, ngram_filter, ngram_score, word_number_filter
from siltworks.plans import families
from siltworks.runtime import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def _docs(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "documents").select("doc_id", "text", "lang", "source", "ingested_at"))


def _code(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "code_input"))


def _quoted(words: tuple[str, ...] | list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


#: Fixed values, stated again for the SQL side so that neither side can carry a slip of the other.
SPACE = "\t\n\v\f\r\u001c-\u001f \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_STOP = "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn".split()
_ENTITY = "nbsp|lt|gt|amp|quot|apos|hellip|ndash|mdash|lsquo|rsquo|ldquo|rdquo"
_PAPERS = r"(?i)身\s{0,10}份|id\s{0,10}number\s{0,10}|identification|identity|\s{0,10}id\s{0,10}no\s{0,10}|id\s{0,10}card\s{0,10}|nric\s{0,10}number\s{0,10}|ic\s{0,10}number\s{0,10}|resident\s{0,10}registration\s{0,10}|i.d.\s{0,10}number\s{0,10}"
_SMILES = [":‑)", ":-))", ":-)", ":)", ":-]", ":]", ":-3", ":3", ":->", ":>", "8-)", "8)", ":-}", ":}", ":o)", ":c)", ":^)", "=]", "=)", ":‑D", ":-D", ":D", "8-D", "8D", "x-D", "xD", "X-D", "XD", "=D", "=3", "B^D", ":-(", ":(", ":-c", ":c", ":-<", ":<", ":-[", ":[", ":-||", ">:[", ":{", ":@", ">:(", ":'-(", ":'(", ":'-)", ":')", "D-':", "D:<", "D:", "D8", "D;", "D=", "DX", ":-O", ":O", ":-o", ":o", ":-0", "8-0", ">:O", ":-*", ":*", ":×", ";-)", ";)", "*-)", "*)", ";-]", ";]", ";^)", ":-,", ";D", ":-P", ":P", "X-P", "XP", "x-p", "xp", ":-p", ":p", "=p", "d:", ":-/", ":/", ":-.", ">:/", "=/", ":L", "=L", ":S", ":-|", ":|", ":$", ":-X", ":X", ":-#", ":#", "O:-)", "O:)", "0:-3", "0:3", ">:-)", ">:)", "}:-)", "}:)", "3:-)", "3:)", "|;-)", "|-O", ":-J", "#-)", "%-)", "%)", "<:-|", "<3", "</3", '\\o/', "^_^", "^.^", "-_-", "T_T", "o_O", "O_o", ">_<", "(^_^)", "(-_-)", "(T_T)", "(>_<)"]
_BLOCKED = ["fraction", "tariff", "n/a"]


_T = "coalesce(text, '')"
_W = f"list_filter(string_split_regex({_T}, '[{SPACE}]+'), lambda x: x <> '')"
_LW = f"list_filter(string_split_regex(lower({_T}), '[{SPACE}]+'), lambda x: x <> '')"
_STRIP = f"regexp_replace({_T}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"
_LINES = f"list_filter(string_split({_T}, chr(10)), lambda x: regexp_replace(x, '[{SPACE}]+', '', 'g') <> '')"
_N = lambda p: f"len(regexp_extract_all({_T}, '{p}'))"

#: filter -> condition in SQL over documents.
_FILTER_SQL = {
    "content_null_filter": f"{_STRIP} <> ''",
    "colon_end_filter": f"{_T} <> '' AND NOT ends_with({_T}, ':')",
    "sentence_number_filter": rf"len(list_filter(string_split_regex({_T}, '[.!?\n]+'), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}_]'))) BETWEEN 3 AND 7500",
    "line_end_with_ellipsis_filter": f"len({_LINES}) > 0 AND len(list_filter({_LINES}, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[{SPACE}]*$'))) / len({_LINES}) < 0.3",
    "symbol_word_ratio_filter": rf"{_N(r'#|\.\.\.|…')} / nullif(len(regexp_extract_all({_T}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACE}]+')), 0) < 0.4",
    "alpha_words_filter": f"len({_W}) > 0 AND len(list_filter({_W}, lambda x: regexp_matches(x, '[a-zA-Z]'))) / len({_W}) > 0.6",
    "html_entity_filter": f"text IS NOT NULL AND NOT regexp_matches(text, '[&＆]({_ENTITY})')",
    "id_card_filter": f"text IS NOT NULL AND {_N(_PAPERS)} < 3",
    "no_punc_filter": f"text IS NOT NULL AND list_max(list_transform(string_split_regex(text, '[–.!?,;•/|…]'), lambda s: len(list_filter(string_split_regex(s, '[{SPACE}]+'), lambda x: x <> '')))) <= 112",
    "special_character_filter": r"text IS NOT NULL AND NOT regexp_matches(text, 'u200e|&#247;|\? :|[�□]|\{/U\}|U\+26[0-F][0-D]|U\+273[3-4]|U\+1F[3-6][0-4][0-F]|U\+1F6[8-F][0-F]')",
    "watermark_filter": "text IS NOT NULL AND NOT regexp_matches(text, 'Copyright|Watermark|Confidential')",
    "mean_word_length_filter": f"len({_W}) > 0 AND round(len(array_to_string({_W}, '')) / len({_W}), 2) >= 3 AND round(len(array_to_string({_W}, '')) / len({_W}), 2) < 10",
    "stop_word_filter": f"len({_LW}) > 0 AND len(list_filter({_LW}, lambda x: x IN ({_quoted(_STOP)}))) > 2 AND len(list_filter({_LW}, lambda x: x IN ({_quoted(_STOP)}))) / len({_LW}) > 0.2",
    "curly_bracket_filter": f"{_T} <> '' AND {_N('[{}]')} / length({_T}) < 0.025",
    "capital_words_filter": f"len({_W}) > 0 AND len(list_filter({_W}, lambda x: x = upper(x) AND x <> lower(x))) / len({_W}) <= 0.2",
    "lorem_ipsum_filter": f"{_T} <> '' AND {_N('(?i)lorem ipsum')} / length({_T}) <= 3e-8",
    "unique_words_filter": f"len({_LW}) > 0 AND len(list_distinct({_LW})) / len({_LW}) > 0.1",
    "char_number_filter": f"length(replace(replace(replace({_STRIP}, ' ', ''), chr(10), ''), chr(9), '')) >= 100",
    "line_start_with_bulletpoint_filter": f"len({_LINES}) > 0 AND len(list_filter({_LINES}, lambda x: regexp_matches(x, '^[{SPACE}]*[•‣▶◀◦■□▪▫–]'))) / len({_LINES}) <= 0.9",
    "line_with_javascript_filter": f"{_T} <> '' AND (len(string_split({_T}, chr(10))) <= 3 OR len(list_filter(string_split({_T}, chr(10)), lambda x: NOT contains(lower(x), 'javascript'))) >= 3)",
    "blocklist_filter": f"{_T} <> '' AND len(list_filter({_LW}, lambda x: x IN ({_quoted(_BLOCKED)}))) <= 1",
}


def _nested_replace(pairs: list[tuple[str, str]]) -> str:
    out = "text"
    for a, b in pairs:
        out = f"replace({out}, {_quoted([a])}, {_quoted([b])})"
    return out


#: refiner -> expression in SQL over documents.
_REFINER_SQL = {
    "lowercase_refiner": "lower(text)",
    "html_entity_refiner": f"regexp_replace(text, '[&＆]({_ENTITY})[;；]', '', 'g')",
    "html_url_remover_refiner": f"regexp_replace(regexp_replace(text, 'https?://[^{SPACE}]+[\\r\\n]*', '', 'g'), '<[^\\n]*?>', '', 'g')",
    "remove_emoji_refiner": f"regexp_replace(text, '[😀-🙏🌀-🗿🚀-\U0001f6ff\U0001f1e0-🇿✂-➰]+', '', 'g')",
    "remove_emoticons_refiner": _nested_replace([(e, "") for e in _SMILES]),
    "remove_extra_spaces_refiner": f"CASE WHEN text IS NOT NULL THEN array_to_string({_W}, ' ') END",
    "remove_number_refiner": r"regexp_replace(text, '[\p{Nd}²³¹⁰⁴-⁹₀-₉]', '', 'g')",
    "remove_punctuation_refiner": r"translate(text, '!\"#$%&()*+,-./:;<=>?@[\]^_`{|}~' || chr(39), '')".replace('\\"', '"'),
    "remove_stopwords_refiner": f"CASE WHEN text IS NOT NULL THEN array_to_string(list_filter({_W}, lambda x: lower(x) NOT IN ({_quoted(_STOP)})), ' ') END",
    "remove_image_refs_refiner": r"regexp_replace(text, '!\[\]\(images/[0-9a-fA-F]\.jpg\)|[a-fA-F0-9]+\.[a-zA-Z]{3,4}\)|!\[\]\(images/[a-f0-9]|图\s+\d+-\d+：[一-龥a-zA-Z0-9]+|[0-9a-zA-Z]{7,}|[一二三四五六七八九十零壹贰叁肆伍陆柒捌玖拾佰仟万亿]{5,}|u200e|&#247;|\? :|[�□]|\{/U\}|U\+26[0-F][0-D]|U\+273[3-4]|U\+1F[3-6][0-4][0-F]|U\+1F6[8-F][0-F]', '', 'g')",
    "reference_remover_refiner": r"regexp_replace(regexp_replace(text, '<ref\b[^>]*>[^<]*</ref>|<ref\b[^>]*>[^<]*$', '', 'g'), '\{\{cite\s+\w+\|[^}]*\}\}|\{\{cite\s+\w+\|[^}]*$', '', 'g')",
    "remove_contractions_refiner": None,
    "text_normalization_refiner": None,
    "remove_repetitions_punctuation_refiner": None,
    "pii_anonymize_refiner": r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\w.+-]+@[\w-]+\.[\w.-]+', '<EMAIL_ADDRESS>', 'g'), '\b(?:\d{1,3}\.){3}\d{1,3}\b', '<IP_ADDRESS>', 'g'), '\b(?:\d[ -]?){13,16}\b', '<CREDIT_CARD>', 'g'), '\b\d{3}-\d{2}-\d{4}\b', '<US_SSN>', 'g'), '\+?\d{1,3}[ -]\(?\d{2,4}\)?(?:[ -]\d{2,4}){2,3}\b', '<PHONE_NUMBER>', 'g')",
}


def _filter_query(name: str) -> Query:
    more = {"blocked": ["fraction", "tariff", "n/a"]} if name == "blocklist_filter" else {}
    return lambda s, d: _docs(s, d).filter(keep(name, F.col("text"), **more)).select("doc_id")


def _refine_query(name: str) -> Query:
    return lambda s, d: _docs(s, d).select("doc_id", refine(name, F.col("text")).alias("text"))


def _dedup_sql(key: str) -> str:
    return f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {key}"


_TOKENS = rf"list_filter(string_split_regex(regexp_replace(lower({_T}), '[^\p{{L}}\p{{N}}_{SPACE}]', '', 'g'), '[{SPACE}]+'), lambda x: x <> '')"
_NGRAMS = "list_transform(range(1, len(t) - 3), lambda i: array_to_string(list_slice(t, i, i + 4), ' '))"
_LL = "list_transform(coalesce(lines, []), lambda x: length(x))"


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pipeline_general").select("pair_id", "instruction", "output", "golden_answer", "source", "ingested_at")


def _distinct_code(s: SparkSession, d: str, *columns: Column) -> DataFrame:
    return _code(s, d).select("id", *columns).distinct()


_SHARED_PARTS = """WITH RECURSIVE texts AS (SELECT min(doc_id) AS id, coalesce(text, '') AS t FROM documents GROUP BY 2),
parts AS (SELECT DISTINCT id, substr(t, CAST(i * n + 1 AS BIGINT), CAST(n AS BIGINT)) AS part FROM (SELECT id, t, floor(length(t) / 3) AS n FROM texts), (SELECT unnest([0, 1, 2]) AS i)),
edges AS (SELECT DISTINCT id AS a, min(id) OVER (PARTITION BY part) AS b FROM parts),
ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT id AS a, id AS b FROM texts UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a)
SELECT a AS doc_id FROM reach GROUP BY a HAVING min(b) = a"""

_OTHER: dict[str, tuple[Query, str | None]] = {
    "op_word_number_filter": (lambda s, d: word_number_filter(_docs(s, d), "text", "n").select("doc_id", F.col("n").cast("bigint").alias("n")), f"SELECT doc_id, len({_W}) AS n FROM documents WHERE len({_W}) >= 20 AND len({_W}) < 100000"),
    "op_ngram_score": (lambda s, d: _docs(s, d).select("doc_id", F.round(ngram_score(F.col("text")), 6).alias("score")), f"SELECT doc_id, round(CASE WHEN len(t) < 5 THEN 0.0 ELSE len(list_distinct({_NGRAMS})) / len({_NGRAMS}) END, 6) AS score FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)"),
    "op_ngram_filter": (lambda s, d: ngram_filter(_docs(s, d), "text").select("doc_id"), f"SELECT doc_id FROM (SELECT doc_id, {_TOKENS} AS t FROM documents) WHERE len(t) >= 5 AND len(list_distinct({_NGRAMS})) / len({_NGRAMS}) BETWEEN 0.8 AND 1.0"),
    "op_general_filter": (lambda s, d: general_filter(_docs(s, d), [F.col("lang") == "en", lambda df: F.length(df["text"]) > 300]).select("doc_id"), "SELECT doc_id FROM documents WHERE lang = 'en' AND length(text) > 300"),
    "op_hash_deduplicate": (lambda s, d: relational.hash_deduplicate(_docs(s, d), ["text"], "doc_id").select("doc_id"), _dedup_sql(_T)),
    "op_hash_deduplicate_two_keys": (lambda s, d: relational.hash_deduplicate(_docs(s, d), ["lang", "text"], "doc_id", "sha256").select("doc_id"), _dedup_sql(f"coalesce(lang, ''), {_T}")),
    "op_ccnet_deduplicate": (lambda s, d: relational.ccnet_deduplicate(_docs(s, d), ["text"], "doc_id").select("doc_id"), _dedup_sql(f"substr(sha1({_T}), 1, 16)")),
    "op_value_counts": (lambda s, d: relational.value_counts(_docs(s, d), "source", "lang"), "SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL"),
    "op_length_statistics": (lambda s, d: relational.length_statistics(_docs(s, d), "text").select("zeros", "least", "greatest", F.round("mean", 4).alias("mean"), "median", "n_rows"), f"SELECT CAST(sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros, CAST(min(n) AS INTEGER) AS least, CAST(max(n) AS INTEGER) AS greatest, round(avg(n), 4) AS mean, CAST(list_extract(list_sort(list(n)), CAST(floor(count(*) / 2) AS BIGINT) + 1) AS INTEGER) AS median, count(*) AS n_rows FROM (SELECT len({_W}) AS n FROM documents)"),
    "op_pretrain_format": (lambda s, d: relational.pretrain_format(_pairs(s, d), "instruction", "output"), "SELECT coalesce(instruction, '') || chr(10) || coalesce(output, '') AS text FROM pipeline_general"),
    "op_answer_votes": (lambda s, d: relational.majority(_pairs(s, d), "source", "golden_answer", "pair_id"), "SELECT source, golden_answer, votes FROM (SELECT source, golden_answer, count(*) AS votes, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, min(pair_id)) AS k FROM pipeline_general WHERE golden_answer IS NOT NULL GROUP BY 1, 2) WHERE k = 1"),
    "op_adjacent_pairs": (lambda s, d: relational.adjacent_pairs(_docs(s, d), "source", "doc_id", "lang"), "SELECT * FROM (SELECT source, doc_id, lang AS first, lead(lang) OVER (PARTITION BY source ORDER BY doc_id) AS second FROM documents) WHERE second IS NOT NULL"),
    "op_chunks": (lambda s, d: relational.chunks(_docs(s, d), "doc_id", "text", 100, 20), f"SELECT doc_id, CAST(c AS INTEGER) AS chunk, array_to_string(list_slice(w, c * 80 + 1, c * 80 + 100), ' ') AS raw_chunk FROM (SELECT doc_id, w, unnest(range(0, greatest(CAST(ceil((len(w) - 20) / 80) AS BIGINT), 1))) AS c FROM (SELECT doc_id, {_W} AS w FROM documents) WHERE len(w) > 0)"),
    "op_nest_extract": (lambda s, d: relational.nest_extract(table(s, d, "events"), {"k": ("props", "$.k")}).select("event_id", F.col("k").cast("bigint").alias("k")), "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL"),
    "op_json_parse_filter": (lambda s, d: relational.json_parse_filter(table(s, d, "events"), "props", "parsed", ("k",), {"k": (10, 60)}).select("event_id"), "SELECT event_id FROM events WHERE try_cast(json_extract_string(props, '$.k') AS DOUBLE) BETWEEN 10 AND 60"),
    "op_union_with_flag": (lambda s, d: relational.union_with_flag(_pairs(s, d).select("pair_id", "instruction"), table(s, d, "raw_code").select("pair_id", "instruction")), "SELECT pair_id, instruction, 'input' AS Synth_or_Input FROM pipeline_general UNION ALL SELECT pair_id, instruction, 'synth' FROM raw_code"),
    "op_code_length": (lambda s, d: (lambda c: _distinct_code(s, d, F.round(c[0], 4).alias("mean_len"), c[1].cast("bigint").alias("max_len"), c[2].alias("score")))(code.length_score(F.col("lines"), F.col("language"))), f"SELECT DISTINCT id, round(coalesce(list_avg({_LL}), 0.0), 4) AS mean_len, coalesce(list_max({_LL}), 0) AS max_len, CASE WHEN len(coalesce(lines, [])) > 100000 OR (CASE WHEN coalesce(language, '') IN ({_quoted(["HTML", "JSON", "Markdown", "Roff", "Roff Manpage", "SMT", "TeX", "Text", "XML"])}) THEN coalesce(list_max({_LL}), 0) > 100000 ELSE coalesce(list_avg({_LL}), 0) > 100 OR coalesce(list_max({_LL}), 0) > 1000 END) THEN 0.0 ELSE 1.0 END AS score FROM code_input"),
    "op_code_duplicate_lines": (lambda s, d: _distinct_code(s, d, F.round(code.duplicate_line_ratio(F.col("lines")), 6).alias("ratio")), "SELECT DISTINCT id, round(CASE WHEN len(l) > 0 THEN 1 - len(list_distinct(l)) / len(l) ELSE 0.0 END, 6) AS ratio FROM (SELECT id, list_filter(coalesce(lines, []), lambda x: trim(x, ' ') <> '') AS l FROM code_input)"),
    "op_minhash_deduplicate": (lambda s, d: near_duplicates.minhash_deduplicate(_docs(s, d), "text", "doc_id").select("doc_id"), None),
    "op_simhash_deduplicate": (lambda s, d: near_duplicates.simhash_deduplicate(_docs(s, d), "text", "doc_id").select("doc_id"), None),
    "op_ngramhash_deduplicate": (lambda s, d: near_duplicates.ngramhash_deduplicate(_docs(s, d), "text", "doc_id").select("doc_id"), _SHARED_PARTS),
    "op_semantic_deduplicate": (lambda s, d: near_duplicates.semantic_deduplicate(table(s, d, "embeddings"), "embedding", "vec_id").select("vec_id"), None),
    "op_lexical_diversity": (lambda s, d: scores.lexical_diversity(_docs(s, d).select("doc_id", "text"), "text").drop("text"), None),
    "op_bleu": (lambda s, d: scores.bleu(spread(_pairs(s, d)), "output", "golden_answer").select("pair_id", F.round("BleuScore", 6).alias("score")), r"SELECT pair_id, round(CASE WHEN len(c) = 0 OR len(r) = 0 THEN 0.0 ELSE (list_sum(list_transform(list_distinct(c), lambda w: least(len(list_filter(c, lambda x: x = w)), len(list_filter(r, lambda x: x = w))))) + 1e-15) / (len(c) + 1e-9) * CASE WHEN len(c) >= len(r) THEN 1.0 ELSE exp(1 - len(r) / len(c)) END END, 6) AS score FROM (SELECT pair_id, " + _W.replace("text", "output") + " AS c, " + _W.replace("text", "golden_answer") + " AS r FROM pipeline_general)"),
    "op_cider": (lambda s, d: scores.cider(_pairs(s, d).groupBy("pair_id").agg(F.min(F.struct("output", "golden_answer")).alias("r")).select("pair_id", "r.*"), "pair_id", "output", "golden_answer").select("pair_id", F.round("CiderScore", 6).alias("score")), None),
    "op_answer_extraction": (lambda s, d: scores.answers(table(s, d, "bench_eval_data").select("item_id", "solution"), "solution").select("item_id", "extracted_answer"), None),
    "op_stemming": (lambda s, d: scores.stemming(_docs(s, d).select("doc_id", "text"), "text"), None),
    "op_vendi": (lambda s, d: scores.vendi(table(s, d, "embeddings"), "embedding"), None),
    "op_k_center": (lambda s, d: scores.k_center(table(s, d, "embeddings"), "vec_id", "embedding", 10).select("vec_id"), None),
}


def queries() -> dict[str, Query]:
    out = {f"op_{n}": _filter_query(n) for n in _FILTER_SQL} | {f"op_{n}": _refine_query(n) for n in _REFINER_SQL}
    return out | {n: q for n, (q, _) in (_OTHER | families.QUERIES).items()}


def oracle_sql() -> dict[str, str]:
    out = {f"op_{n}": f"SELECT doc_id FROM documents WHERE {c}" for n, c in _FILTER_SQL.items()}
    out |= {f"op_{n}": f"SELECT doc_id, {e} AS text FROM documents" for n, e in _REFINER_SQL.items() if e}
    return out | {n: sql for n, (_, sql) in (_OTHER | families.QUERIES).items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, filter, deduplicate and score the documents in one plan."""
    df = _docs(spark, sf_dir).withColumn("text", refine("remove_extra_spaces_refiner", refine("html_entity_refiner", F.col("text"))))
    ok = keep("content_null_filter", F.col("text")) & keep("curly_bracket_filter", F.col("text")) & keep("symbol_word_ratio_filter", F.col("text")) & keep("char_number_filter", F.col("text"))
    return relational.hash_deduplicate(df.filter(ok), ["text"], "doc_id").select("doc_id", "lang", F.length("text").alias("n_chars"), F.round(ngram_score(F.col("text")), 6).alias("ngram_score"))
