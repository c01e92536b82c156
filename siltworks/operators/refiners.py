"""Refiners: each rewrites one text column in place; nulls stay null."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions.text import GAP, U, WORD, let, words
from siltworks.operators.rule_filters import ENTITIES, STOPWORDS
from siltworks.registry import register
from siltworks.runtime import require

#: Emoji ranges, ASCII punctuation, contractions and their full forms, words that take 's for is, endings, months, emoticons, patterns
#: of personal data, and the alternatives of image references. Two of these have a repeated group in the rule that they follow; they are written
#: here as one counted run, which matches the same and needs no back-tracking.
EMOJI = "[\U0001f600-\U0001f64f\U0001f300-\U0001f5ff\U0001f680-\U0001f6ff\U0001f1e0-\U0001f1ff\u2702-\u27b0]+"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
CONTRACTIONS = {"can't": "cannot", "won't": "will not", "shan't": "shall not", "ain't": "are not", "let's": "let us", "y'all": "you all", "ma'am": "madam", "o'clock": "of the clock", "gonna": "going to", "gotta": "got to", "wanna": "want to", "gimme": "give me", "lemme": "let me", "'cause": "because", "'tis": "it is", "'twas": "it was", "i'm": "I am", "how'd": "how did", "where'd": "where did", "why'd": "why did"}
WITH_IS = ("he", "she", "it", "that", "this", "there", "here", "what", "where", "who", "when", "how", "why", "somebody", "someone", "everybody", "everyone", "something", "everything", "nobody")
ENDINGS = (("n't", " not"), ("'re", " are"), ("'ve", " have"), ("'ll", " will"), ("'d", " would"), ("'m", " am"))
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
EMOTICONS = (":‑)", ":-))", ":-)", ":)", ":-]", ":]", ":-3", ":3", ":->", ":>", "8-)", "8)", ":-}", ":}", ":o)", ":c)", ":^)", "=]", "=)", ":‑D", ":-D", ":D", "8-D", "8D", "x-D", "xD", "X-D", "XD", "=D", "=3", "B^D", ":-(", ":(", ":-c", ":c", ":-<", ":<", ":-[", ":[", ":-||", ">:[", ":{", ":@", ">:(", ":'-(", ":'(", ":'-)", ":')", "D-':", "D:<", "D:", "D8", "D;", "D=", "DX", ":-O", ":O", ":-o", ":o", ":-0", "8-0", ">:O", ":-*", ":*", ":×", ";-)", ";)", "*-)", "*)", ";-]", ";]", ";^)", ":-,", ";D", ":-P", ":P", "X-P", "XP", "x-p", "xp", ":-p", ":p", "=p", "d:", ":-/", ":/", ":-.", ">:/", "=/", ":L", "=L", ":S", ":-|", ":|", ":$", ":-X", ":X", ":-#", ":#", "O:-)", "O:)", "0:-3", "0:3", ">:-)", ">:)", "}:-)", "}:)", "3:-)", "3:)", "|;-)", "|-O", ":-J", "#-)", "%-)", "%)", "<:-|", "<3", "</3", "\\o/", "^_^", "^.^", "-_-", "T_T", "o_O", "O_o", ">_<", "(^_^)", "(-_-)", "(T_T)", "(>_<)")
PII = ((r"[\w.+-]+@[\w-]+\.[\w.-]+", "<EMAIL_ADDRESS>"), (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<IP_ADDRESS>"), (r"\b(?:\d[ -]?){13,16}\b", "<CREDIT_CARD>"), (r"\b\d{3}-\d{2}-\d{4}\b", "<US_SSN>"), (r"\+?\d{1,3}[ -]\(?\d{2,4}\)?(?:[ -]\d{2,4}){2,3}\b", "<PHONE_NUMBER>"))
IMAGE_REFS = r"!\[\]\(images/[0-9a-fA-F]\.jpg\)|[a-fA-F0-9]+\.[a-zA-Z]{3,4}\)|!\[\]\(images/[a-f0-9]|图\s+\d+-\d+：[一-龥a-zA-Z0-9]+|[0-9a-zA-Z]{7,}|[一二三四五六七八九十零壹贰叁肆伍陆柒捌玖拾佰仟万亿]{5,}|u200e|&#247;|\? :|[�□]|\{/U\}|U\+26[0-F][0-D]|U\+273[3-4]|U\+1F[3-6][0-4][0-F]|U\+1F6[8-F][0-F]"

_REFINE: dict[str, Callable[..., Column]] = {}


def _refiner(name: str) -> Callable[[Callable[..., Column]], Callable[..., Column]]:
    def put(f: Callable[..., Column]) -> Callable[..., Column]:
        _REFINE[name] = f

        def op(df: DataFrame, input_key: str, **parameters: object) -> DataFrame:
            require(df, input_key)
            return df.withColumn(input_key, F.when(F.col(input_key).isNotNull(), f(F.col(input_key), **parameters)))

        op.__doc__ = f.__doc__
        register(name)(op)
        return op

    return put


def refine(name: str, c: Column, **parameters: object) -> Column:
    return F.when(c.isNotNull(), _REFINE[name](c, **parameters))


@_refiner("lowercase_refiner")
def _lower(c: Column) -> Column:
    return F.lower(c)


@_refiner("html_entity_refiner")
def _entity(c: Column, html_entities: tuple[str, ...] = ENTITIES) -> Column:
    """Deletes entities with either kind of ampersand and semicolon."""
    return F.regexp_replace(c, "[&＆](?:" + "|".join(html_entities) + ")[;；]", "")


@_refiner("html_url_remover_refiner")
def _html(c: Column) -> Column:
    """Deletes addresses with the line ends after them, then tags that don't cross a line end."""
    return F.regexp_replace(F.regexp_replace(c, f"{U}https?://[^{GAP}]+[\\r\\n]*", ""), r"<[^\n]*?>", "")


@_refiner("remove_emoji_refiner")
def _emoji(c: Column) -> Column:
    return F.regexp_replace(c, EMOJI, "")


@_refiner("remove_emoticons_refiner")
def _emoticons(c: Column, emoticons: tuple[str, ...] = EMOTICONS) -> Column:
    for e in emoticons:
        c = F.replace(c, F.lit(e), F.lit(""))
    return c


@_refiner("remove_extra_spaces_refiner")
def _spaces(c: Column) -> Column:
    return F.array_join(words(c), " ")


@_refiner("remove_number_refiner")
def _numbers(c: Column) -> Column:
    """Deletes decimal digits of all scripts and super- and subscript digits."""
    return F.regexp_replace(c, r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]", "")


@_refiner("remove_punctuation_refiner")
def _punctuation(c: Column) -> Column:
    return F.regexp_replace(c, PUNCTUATION, "")


@_refiner("remove_repetitions_punctuation_refiner")
def _repeated(c: Column) -> Column:
    """One of each run of the same punctuation character."""
    return F.regexp_replace(c, f"{U}([^{WORD}{GAP}]|_)\\1+", "$1")


@_refiner("remove_stopwords_refiner")
def _stopwords(c: Column) -> Column:
    return F.array_join(F.filter(words(c), lambda w: ~F.lower(w).isin(STOPWORDS)), " ")


@_refiner("remove_image_refs_refiner")
def _images(c: Column) -> Column:
    """Deletes image references and, as part of them, runs of seven or more letters and digits."""
    return F.regexp_replace(c, IMAGE_REFS, "")


@_refiner("reference_remover_refiner")
def _references(c: Column) -> Column:
    """Deletes references and citation templates, whole or cut off at the end."""
    c = F.regexp_replace(c, r"<ref\b[^>]*>[^<]*</ref>|<ref\b[^>]*>[^<]*$", "")
    return F.regexp_replace(c, r"\{\{cite\s+\w+\|[^}]*\}\}|\{\{cite\s+\w+\|[^}]*$", "")


@_refiner("remove_contractions_refiner")
def _contractions(c: Column) -> Column:
    """Full forms in place of contractions, in any case and with either apostrophe; a capital first letter stays one."""
    c = F.regexp_replace(c, "[’ʼ]", "'")
    for a, b in CONTRACTIONS.items():
        for x, y in ((a, b), (a.capitalize(), b[0].upper() + b[1:]), (a.upper(), b.upper())):
            if x != x.lower() or x == a:
                c = F.regexp_replace(c, rf"(?<![\p{{L}}\p{{N}}']){x}(?![\p{{L}}\p{{N}}'])", y)
    c = F.regexp_replace(c, rf"(?i)\b({'|'.join(WITH_IS)})'s(?![\p{{L}}\p{{N}}])", "$1 is")
    for a, b in ENDINGS:
        c = F.regexp_replace(c, rf"(?i)(?<=\p{{L}}){a}(?![\p{{L}}\p{{N}}])", b)
    return c


@_refiner("pii_anonymize_refiner")
def _pii(c: Column) -> Column:
    """Placeholders for mail and network addresses, card, social security and phone numbers."""
    for p, name in PII:
        c = F.regexp_replace(c, p, name)
    return c


@_refiner("text_normalization_refiner")
def _normal(c: Column) -> Column:
    """Dates of day, month and year in figures to year-month-day as written; of the dates with an English month's name the first of each form (Month d, yyyy; d Month yyyy), wherever it stands, to ISO; $n to n USD."""
    c = F.regexp_replace(c, r"(\d{1,2})[/.](\d{1,2})[/.](\d{2,4})", "$3-$2-$1")
    for pattern, month, day, year in ((r"(?U)\b(\w+)\s+(\d{1,2}),\s+(\d{4})\b", 1, 2, 3), (r"(?U)\b(\d{1,2})\s+(\w+)\s+(\d{4})\b", 2, 1, 3)):
        c = let(c, _month_date(pattern, month, day, year))
    return F.regexp_replace(c, r"\$\s?(\d+)", "$1 USD")


def _month_date(pattern: str, month: int, day: int, year: int) -> Callable[[Column], Column]:
    def of(t: Column) -> Column:
        part = lambda k: F.regexp_extract(t, pattern, k)
        n = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(part(month)))
        iso = F.concat(part(year), F.lit("-"), F.lpad(n.cast("string"), 2, "0"), F.lit("-"), F.lpad(part(day), 2, "0"))
        return F.when((n > 0) & F.try_to_date(iso, "yyyy-MM-dd").isNotNull(), F.replace(t, part(0), iso)).otherwise(t)

    return of


@register("ner_refiner")
def ner(df: DataFrame, input_key: str, entities: Callable[[list[str]], list[list[tuple[str, str]]]]) -> DataFrame:
    """Each entity by its label in brackets, wherever it stands in the text. entities: texts -> (entity, label) pairs of each; it runs on executors."""
    require(df, input_key)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        some = [t if isinstance(t, str) else "" for t in texts]
        out = []
        for t, found in zip(some, entities(some)):
            for name, label in found:
                t = t.replace(name, f"[{label}]")
            out.append(t)
        return pd.Series(out, dtype=object)

    return df.withColumn(input_key, F.when(F.col(input_key).isNotNull(), run(F.col(input_key))))
