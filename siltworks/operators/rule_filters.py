"""Filters by a rule on one text column. Each adds a label column (1) and keeps the rows that pass.

`keep(name, column, **parameters)` gives the bare condition, for use in other plans. A null or empty text passes a rule
only where the rule says so; extra columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions.text import GAP, U, WORD, char_ngrams, count, let, lines, n_words, ngrams, nz, ratio, share, strip, words
from siltworks.registry import register
from siltworks.runtime import forbid, require

#: Entities, bullets, identity terms, special characters, English stop words.
ENTITIES = ("nbsp", "lt", "gt", "amp", "quot", "apos", "hellip", "ndash", "mdash", "lsquo", "rsquo", "ldquo", "rdquo")
BULLETS = "\u2022\u2023\u25b6\u25c0\u25e6\u25a0\u25a1\u25aa\u25ab\u2013"
IDENTITY = r"(?i)(身\s{0,10}份|id\s{0,10}number\s{0,10}|identification|identity|\s{0,10}id\s{0,10}no\s{0,10}|id\s{0,10}card\s{0,10}|nric\s{0,10}number\s{0,10}|ic\s{0,10}number\s{0,10}|resident\s{0,10}registration\s{0,10}|i.d.\s{0,10}number\s{0,10})"
SPECIAL = r"u200e|&#247;|\? :|[�□]|\{/U\}|U\+26[0-F][0-D]|U\+273[3-4]|U\+1F[3-6][0-4][0-F]|U\+1F6[8-F][0-F]"
SEGMENT = "[–.!?,;•/|…]"
STOPWORDS = "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn".split()

_RULES: dict[str, Callable[..., Column]] = {}


def _rule(name: str, label: str | None = None) -> Callable[[Callable[..., Column]], Callable[..., Column]]:
    def put(f: Callable[..., Column]) -> Callable[..., Column]:
        _RULES[name] = f

        def op(df: DataFrame, input_key: str, output_key: str | None = None, **parameters: object) -> DataFrame:
            require(df, input_key)
            out = output_key or label or f"{name}_label"
            forbid(df, out)
            return df.withColumn(out, F.coalesce(f(F.col(input_key), **parameters), F.lit(False)).cast("int")).filter(F.col(out) == 1)

        op.__doc__ = f.__doc__
        register(name)(op)
        return op

    return put


def keep(name: str, c: Column, **parameters: object) -> Column:
    return F.coalesce(_RULES[name](c, **parameters), F.lit(False))


@_rule("content_null_filter")
def _content_null(c: Column) -> Column:
    """Keeps texts that aren't null or blank."""
    return strip(c) != ""


@_rule("colon_end_filter")
def _colon_end(c: Column) -> Column:
    """Keeps texts that don't end with a colon; empty ones go."""
    return (nz(c) != "") & ~nz(c).endswith(":")


@_rule("sentence_number_filter")
def _sentences(c: Column, min_sentences: int = 3, max_sentences: int = 7500) -> Column:
    """Number of segments between sentence marks and line ends that have a word in them, within both bounds."""
    n = F.size(F.filter(F.split(nz(c), r"[.!?\n]+"), lambda s: s.rlike(f"[{WORD}]")))
    return n.between(min_sentences, max_sentences)


@_rule("line_end_with_ellipsis_filter")
def _ellipsis(c: Column, threshold: float = 0.3) -> Column:
    """Share of lines that end in an ellipsis, under the threshold; texts without lines go."""
    return share(lines(c), lambda x: x.rlike(f"{U}(?:\\.\\.\\.|…)[{GAP}]*$")) < threshold


@_rule("symbol_word_ratio_filter")
def _symbols(c: Column, threshold: float = 0.4) -> Column:
    """Hashes and ellipses for each word or run of punctuation, under the threshold."""
    return ratio(count(c, r"#|\.\.\.|…"), count(c, f"{U}[{WORD}]+|[^{WORD}{GAP}]+")) < threshold


@_rule("alpha_words_filter")
def _alpha(c: Column, threshold: float = 0.6) -> Column:
    """Share of words with a Latin letter, over the threshold."""
    return share(words(c), lambda x: x.rlike("[a-zA-Z]")) > threshold


@_rule("html_entity_filter")
def _entities(c: Column) -> Column:
    """Drops texts with an entity in full or half form, so also its prefix in a longer name."""
    return c.isNotNull() & ~nz(c).rlike("[&＆](?:" + "|".join(ENTITIES) + ")")


@_rule("id_card_filter")
def _identity(c: Column, threshold: int = 3) -> Column:
    """Number of terms for identity papers, under the threshold."""
    return c.isNotNull() & (count(c, IDENTITY) < threshold)


@_rule("no_punc_filter")
def _no_punc(c: Column, threshold: int = 112) -> Column:
    """Most words without punctuation between them, up to the threshold."""
    return c.isNotNull() & (F.array_max(F.transform(F.split(nz(c), SEGMENT), lambda s: n_words(s))) <= threshold)


@_rule("special_character_filter")
def _special(c: Column) -> Column:
    """Drops texts with broken or escaped symbols."""
    return c.isNotNull() & ~nz(c).rlike(SPECIAL)


@_rule("watermark_filter")
def _watermark(c: Column, watermarks: tuple[str, ...] = ("Copyright", "Watermark", "Confidential")) -> Column:
    """Drops texts that a watermark pattern matches, by case."""
    return c.isNotNull() & ~nz(c).rlike("|".join(watermarks))


@_rule("mean_word_length_filter")
def _mean_length(c: Column, min_length: float = 3, max_length: float = 10) -> Column:
    """Mean length of words to two places, from min_length to below max_length."""
    mean = lambda w: F.round(ratio(F.length(F.array_join(w, "")), F.size(w)), 2)
    return let(let(words(c), mean), lambda m: (m >= min_length) & (m < max_length))


@_rule("stop_word_filter")
def _stop_words(c: Column, threshold: float = 0.2) -> Column:
    """Share of English stop words over the threshold, and more than two of them."""
    enough = lambda w: let(F.size(F.filter(w, lambda x: x.isin(STOPWORDS))), lambda n: (ratio(n, F.size(w)) > threshold) & (n > 2))
    return let(words(F.lower(nz(c))), enough)


@_rule("curly_bracket_filter")
def _curly(c: Column, threshold: float = 0.025) -> Column:
    """Share of braces among the characters, under the threshold."""
    return ratio(count(c, r"[{}]"), F.length(nz(c))) < threshold


@_rule("capital_words_filter", "capital_words_filter")
def _capitals(c: Column, threshold: float = 0.2) -> Column:
    """Share of words in capitals, up to the threshold."""
    return share(words(c), lambda x: (x == F.upper(x)) & (x != F.lower(x))) <= threshold


@_rule("lorem_ipsum_filter", "loremipsum_filter_label")
def _lorem(c: Column, threshold: float = 3e-8) -> Column:
    """Placeholder text for each character, up to the threshold."""
    return ratio(count(c, "(?i)lorem ipsum"), F.length(nz(c))) <= threshold


@_rule("unique_words_filter", "unique_words_filter")
def _unique(c: Column, threshold: float = 0.1) -> Column:
    """Share of different words, over the threshold."""
    return let(words(F.lower(nz(c))), lambda w: ratio(F.size(F.array_distinct(w)), F.size(w)) > threshold)


@_rule("char_number_filter")
def _chars(c: Column, threshold: int = 100) -> Column:
    """Characters without spaces, tabs and line feeds, at least the threshold."""
    return F.length(F.regexp_replace(strip(c), r"[ \n\t]", "")) >= threshold


@_rule("line_start_with_bulletpoint_filter", "line_start_with_bullet_point_filter_label")
def _bullets(c: Column, threshold: float = 0.9) -> Column:
    """Share of lines that start with a bullet, up to the threshold."""
    return share(lines(c), lambda x: x.rlike(f"{U}^[{GAP}]*[{BULLETS}]")) <= threshold


@_rule("line_with_javascript_filter")
def _javascript(c: Column, threshold: int = 3) -> Column:
    """Keeps texts of up to three lines, or with enough lines that don't say javascript."""
    enough = lambda ls: (F.size(ls) <= 3) | (F.size(F.filter(ls, lambda x: ~F.lower(x).contains("javascript"))) >= threshold)
    return (nz(c) != "") & let(F.split(nz(c), "\n"), enough)


@_rule("blocklist_filter")
def _blocklist(c: Column, blocked: list[str] | tuple[str, ...], threshold: int = 1) -> Column:
    """Number of blocked words, up to the threshold; empty texts go. blocked: the list, as of `word_list`; it stays in the plan as a hash set."""
    return (nz(c) != "") & (F.size(F.filter(words(F.lower(nz(c))), lambda w: w.isin([b.lower() for b in blocked]))) <= threshold)


def word_list(spark: object, path: str, bound: int = 100_000) -> list[str]:
    """The different lines of a text file of settings, in lower case; more than `bound` are an error."""
    rows = spark.read.text(path).select(F.lower(F.trim("value")).alias("w")).filter("w != ''").distinct().limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"{path} has more than {bound} lines")
    return sorted(r["w"] for r in rows)


@register("blocklist_table_filter")
def blocklist_table(df: DataFrame, key: str, input_key: str, blocked: DataFrame, threshold: int = 1) -> DataFrame:
    """blocklist_filter for a list of any length: blocked has a column `word`; the texts' words are joined with it. key: unique in df."""
    require(df, key, input_key)
    hits = df.select(key, F.explode(words(F.lower(nz(input_key)))).alias("word")).join(blocked.select(F.lower("word").alias("word")).distinct(), "word", "left_semi").groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > threshold)
    return df.filter(nz(input_key) != "").join(hits, key, "left_anti")


@register("word_number_filter")
def word_number_filter(df: DataFrame, input_key: str, output_key: str = "word_number_filter_label", min_words: int = 20, max_words: int = 100_000) -> DataFrame:
    """Number of words, from min_words to below max_words; the output column holds the number."""
    require(df, input_key)
    n = F.col(output_key)
    return df.withColumn(output_key, n_words(input_key)).filter((n >= min_words) & (n < max_words))


def ngram_score(c: Column, n: int = 5, by_word: bool = True) -> Column:
    """Share of different n-grams of the words (or characters), without punctuation and case; 0 where there is none."""
    plain = F.regexp_replace(F.lower(nz(c)), f"{U}[^{WORD}{GAP}]", "")
    grams = ngrams(words(plain), n) if by_word else char_ngrams(plain, n)
    return let(grams, lambda g: F.when(F.size(g) == 0, F.lit(0.0)).otherwise(F.size(F.array_distinct(g)) / F.size(g)))


@register("ngram_sample_evaluator")
def ngram_evaluator(df: DataFrame, input_key: str, output_key: str = "NgramScore", ngrams: int = 5, by_word: bool = True) -> DataFrame:
    """df with the share of different n-grams."""
    require(df, input_key)
    return df.withColumn(output_key, ngram_score(F.col(input_key), ngrams, by_word))


@register("ngram_filter")
def ngram_filter(df: DataFrame, input_key: str, output_key: str = "NgramScore", min_score: float = 0.8, max_score: float = 1.0, ngrams: int = 5, by_word: bool = True) -> DataFrame:
    """Rows whose share of different n-grams lies within both bounds."""
    return ngram_evaluator(df, input_key, output_key, ngrams, by_word).filter(F.col(output_key).between(min_score, max_score))


@register("general_filter")
def general_filter(df: DataFrame, filter_rules: list) -> DataFrame:
    """Rows for which every rule holds; a rule is a Column or a function of the frame that gives one."""
    for r in filter_rules:
        df = df.filter(r(df) if callable(r) else r)
    return df


@register("generic_score_filter")
def generic_score_filter(df: DataFrame, input_key: str, output_key: str = "generic_score_filter_label", score_threshold: float = 8, filter_method: str = "greater_equal") -> DataFrame:
    c, t = F.col(input_key), score_threshold
    ok = {"greater": c > t, "greater_equal": c >= t, "less": c < t, "less_equal": c <= t, "equal": c == t}
    if filter_method not in ok:
        raise ValueError(f"filter_method is one of {', '.join(ok)}")
    return df.withColumn(output_key, F.coalesce(ok[filter_method], F.lit(False)).cast("int")).filter(F.col(output_key) == 1)
