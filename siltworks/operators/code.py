"""Scores and filters of source files by their lines and text. A file is a struct or columns `lines`, `text`, `language`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions.text import WORD, count, let, ngram_hashes, nz, strip
from siltworks.registry import register

#: Types whose length is checked; names of files that may be of type text; languages whose digits count as content.
SIZED = ("text", "json", "yaml", "web ontology language", "graphviz", "dot")
TEXT_NAMES = ("readme", "notes", "todo", "description", "cmakelists")
SYMBOLIC = ("Motorola 68K Assembly", "WebAssembly")
#: Markers of generated files; languages whose long lines are usual; patterns of encoded data.
MARKERS = ("auto-generated", "autogenerated", "automatically generated", "generated automatically", "this file is generated")
LONG_LINED = ("HTML", "JSON", "Markdown", "Roff", "Roff Manpage", "SMT", "TeX", "Text", "XML")
# Possessive: Java recurses for each repetition of a group that it could take back, and a long dump overflows the stack. An item can be
# read in one way only, so there is nothing to take back and the matches are the same.
ENCODED = {"base64": r"[a-zA-Z0-9+/=\n]{64,}", "hex": r"(?:\b(?:0x|\\x)?[0-9a-fA-F]{2}(?:,|\b\s*)){8,}+", "unicode": r"(?:\\u[0-9a-fA-F]{4}){8,}+"}


def marker_count(lines: Column) -> Column:
    head = F.lower(F.array_join(F.slice(F.coalesce(lines, F.array().cast("array<string>")), 1, 5), "\n"))
    return sum((F.when(head.contains(m), 1).otherwise(0) for m in MARKERS), F.lit(0))


def length_score(lines: Column, language: Column) -> tuple[Column, Column, Column]:
    """(mean line length, longest line, score 0 or 1)."""
    ls = F.transform(F.coalesce(lines, F.array().cast("array<string>")), lambda x: F.length(x))
    n = F.size(ls)
    mean = F.when(n > 0, F.aggregate(ls, F.lit(0).cast("bigint"), lambda a, x: a + x) / n).otherwise(F.lit(0.0))
    longest = F.when(n > 0, F.array_max(ls)).otherwise(F.lit(0))
    usual = F.coalesce(language.isin(*LONG_LINED), F.lit(False))
    bad = (n > 100_000) | F.when(usual, longest > 100_000).otherwise((mean > 100) | (longest > 1000))
    return mean, longest, F.when(bad, 0.0).otherwise(1.0)


def encoded_ratio(text: Column, kind: str) -> Column:
    """Share of the characters in matches of one pattern of encoded data."""
    m = F.regexp_extract_all(nz(text), F.lit(ENCODED[kind]), F.lit(0))
    return F.aggregate(m, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)) / F.greatest(F.length(nz(text)), F.lit(1))


def alpha_ratio(text: Column) -> Column:
    return F.length(F.regexp_replace(nz(text), r"\P{L}", "")) / F.greatest(F.length(nz(text)), F.lit(1))


def _filter(score: str) -> object:
    """The filter on a score: within [low, high], ends included; a missing score passes."""
    def op(df: DataFrame, low: float = 1.0, high: float = 1.0) -> DataFrame:
        got, c = EVALUATORS[score](df), F.col(f"Code{score}Score")
        return got.filter(c.isNull() | F.isnan(c) | c.between(low, high))

    return op


@register("code_auto_generated_sample_evaluator")
def auto_generated(df: DataFrame, extra: Column | None = None) -> DataFrame:
    """df with the number of markers and a score of 1 for none, else 0. extra: a further condition that means generated."""
    n = marker_count(F.col("lines"))
    bad = (n > 0) if extra is None else (n > 0) | F.coalesce(extra, F.lit(False))
    return df.withColumns({"CodeAutoGeneratedMarkerCount": n, "CodeAutoGeneratedScore": F.when(bad, 0.0).otherwise(1.0)})


@register("code_length_sample_evaluator")
def length(df: DataFrame) -> DataFrame:
    mean, longest, score = length_score(F.col("lines"), F.col("language"))
    return df.withColumns({"CodeLengthTotalLines": F.size(F.coalesce("lines", F.array().cast("array<string>"))), "CodeLengthAvg": mean, "CodeLengthMax": longest, "CodeLengthScore": score})


@register("code_encoded_data_sample_evaluator")
def encoded(df: DataFrame) -> DataFrame:
    """df with the share of each kind of encoded data and a score of 0 if one is over a half."""
    r = {f"CodeEncodedData{k.title()}Ratio": encoded_ratio(F.col("text"), k) for k in ENCODED}
    return df.withColumns(r).withColumn("CodeEncodedDataScore", F.when(F.greatest(*r) > 0.5, 0.0).otherwise(1.0))


@register("code_text_composition_sample_evaluator")
def composition(df: DataFrame, least: float = 0.25) -> DataFrame:
    """df with the shares of letters and of letters and digits; the score looks at letters, for assembly languages at both."""
    letters, both = alpha_ratio(F.col("text")), F.length(F.regexp_replace(nz("text"), r"[^\p{L}\p{N}]", "")) / F.greatest(F.length(nz("text")), F.lit(1))
    seen = F.when(F.col("language").isin(*SYMBOLIC), F.col("CodeTextCompositionAlnumRatio")).otherwise(F.col("CodeTextCompositionAlphaRatio"))
    return df.withColumns({"CodeTextCompositionAlphaRatio": letters, "CodeTextCompositionAlnumRatio": both}).withColumn("CodeTextCompositionScore", F.when(seen < least, 0.0).otherwise(1.0))


#: Accepted ranges of the document metrics.
DOCUMENT = {"min_num_chars": 1, "max_num_chars": 100_000, "min_num_words": 1, "max_num_words": 100_000, "max_frac_duplicate_lines": 1.0, **{f"max_frac_duplicate_{n}gram": 1.0 for n in range(2, 11)}, "max_frac_curly_bracket": 1.0, "max_frac_all_caps_words": 1.0, "min_entropy_unigram": 0.0}


def repeated_share(items: Column) -> Column:
    """Share of the items that stand more than once, by runs in sorted order; 0 for none."""
    def runs(s: Column) -> Column:
        n = F.size(s)
        twice = F.filter(F.transform(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1)) | (i < n - 1) & (x == F.get(s, i + 1))), lambda b: b)
        return F.when(n > 0, F.size(twice) / n).otherwise(F.lit(0.0))

    return let(F.array_sort(items), runs)


def entropy(items: Column) -> Column:
    """Shannon entropy of the items in bits, from the places where a sorted item ends."""
    def of(s: Column) -> Column:
        n = F.size(s)
        ends = F.filter(F.transform(s, lambda x, i: F.when((i == n - 1) | (x != F.get(s, i + 1)), i + 1)), lambda i: i.isNotNull())
        counts = let(ends, lambda e: F.transform(e, lambda x, i: x - F.when(i > 0, F.get(e, i - 1)).otherwise(F.lit(0))))
        return F.when(n > 0, F.aggregate(counts, F.lit(0.0), lambda a, c: a - (c / n) * F.log2(c / n))).otherwise(F.lit(0.0))

    return let(F.array_sort(items), of)


@register("code_document_quality_sample_evaluator")
def document_quality(df: DataFrame, thresholds: dict[str, float] | None = None, text: str = "text") -> DataFrame:
    """df with length, repetition, brackets, capitals and entropy of each document, and a score of 1 if all lie in their ranges, else 0."""
    t = {**DOCUMENT, **(thresholds or {})}
    c = nz(text)
    lines = F.filter(F.transform(F.split(c, r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"), strip), lambda x: x != "")
    w = F.regexp_extract_all(c, F.lit(f"[{WORD}]+"), F.lit(0))
    base = df.withColumn("_w", w)
    n = F.size("_w")
    caps = F.size(F.filter("_w", lambda x: (x == F.upper(x)) & (x != F.lower(x)) & (F.length(x) > 1)))
    d = "CodeDocumentQuality"
    grams = {f"{d}Duplicate_{k}Gram_RatioRatio": repeated_share(ngram_hashes(F.col("_w"), k)) for k in range(2, 11)}
    got = base.withColumns({f"{d}CharCount": F.length(c), f"{d}WordCount": n, f"{d}DuplicateLinesRatio": repeated_share(lines), f"{d}CurlyBracketRatio": F.when(F.length(c) > 0, count(c, "[{}]") / F.length(c)).otherwise(F.lit(0.0)), f"{d}AllCapsRatio": F.when(n > 0, caps / n).otherwise(F.lit(0.0)), f"{d}Entropy": entropy(F.col("_w")), **grams}).drop("_w")
    ok = F.col(f"{d}CharCount").between(t["min_num_chars"], t["max_num_chars"]) & F.col(f"{d}WordCount").between(t["min_num_words"], t["max_num_words"]) & (F.col(f"{d}DuplicateLinesRatio") <= t["max_frac_duplicate_lines"]) & (F.col(f"{d}CurlyBracketRatio") <= t["max_frac_curly_bracket"]) & (F.col(f"{d}AllCapsRatio") <= t["max_frac_all_caps_words"]) & (F.col(f"{d}Entropy") >= t["min_entropy_unigram"])
    for k in range(2, 11):
        ok = ok & (F.col(f"{d}Duplicate_{k}Gram_RatioRatio") <= t[f"max_frac_duplicate_{k}gram"])
    return got.withColumn(f"{d}Score", F.when(ok, 1.0).otherwise(0.0))


EVALUATORS = {"AutoGenerated": auto_generated, "Length": length, "EncodedData": encoded, "TextComposition": composition, "DocumentQuality": document_quality}
for _score, _name in (("AutoGenerated", "code_auto_generated_filter"), ("Length", "code_length_sample_filter"), ("EncodedData", "code_encoded_data_filter"), ("TextComposition", "code_text_composition_filter"), ("DocumentQuality", "code_document_quality_filter")):
    register(_name)(_filter(_score))


@register("code_file_type_content_filter")
def type_filter(df: DataFrame, check_names: bool = False) -> DataFrame:
    """Data formats and texts of at most 512 lines; HTML with enough visible text; everything else.

    check_names: a text's name must also be that of documentation. The rule this follows has such a check, but asks for the length of texts
    before it and so never comes to it; by default it isn't made here either.
    """
    kind, name = F.lower(nz("filetype")), F.lower(nz("filename"))
    visible = (F.col("visible_text_length") >= 100) & (F.col("visible_text_length") / F.greatest(F.col("total_code_length"), F.lit(1)) >= 0.2)
    named = name.contains("requirement") | F.regexp_replace(name, r"\.[^.]*$", "").isin(*TEXT_NAMES) | F.lit(not check_names)
    short = F.coalesce(F.col("line_count") <= 512, F.lit(True))
    return df.filter(F.coalesce(F.when(kind == "text", short & named).when(kind.isin(*SIZED), short).when(kind == "html", visible).otherwise(F.lit(True)), F.lit(True)))


def duplicate_line_ratio(lines: Column) -> Column:
    ls = F.filter(F.coalesce(lines, F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    return F.when(F.size(ls) > 0, 1 - F.size(F.array_distinct(ls)) / F.size(ls)).otherwise(F.lit(0.0))
