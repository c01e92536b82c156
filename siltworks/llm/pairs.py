"""Problem 2: prompt and response pairs whose response fails the prompt.

Method: the response is cut into clauses (sentences, list items, code blocks, section marks); a linear-chain conditional
random field tags each as answer, refusal, echo, foreign or unfinished; the tags' coverage of the response gives the
pair's defect. The field is fitted by gradient ascent on the likelihood of `TRAIN_PAIRS` made pairs (a fixed bound), from
the common words of the languages and invented words; its features are stated in FEATURES. A made response is put together from
pieces, each made as an answer, a refusal, an echo, foreign or unfinished text, and a clause has the tag of the piece that it begins in,
whatever its features say. A response without a clause that
could answer is `empty` before any tagging. A pair has the first that holds of: empty, refusal (the response opens with
refusing clauses, or they cover half of it), copied (nothing but echo), other_language (more than half foreign), truncated
(its last clause is unfinished).

The prompt is the instruction, or the input where the instruction is blank. Null prompts count as empty ones; a pair
delivered twice gives one row, and if copies differ any defective copy counts, by the order above.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm.quality import common_words
from siltworks.runtime import require, spread, table

TRAIN_PAIRS = 3000
TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
FEATURES = ("bias", "refuses", "courtesy", "echo", "foreign", "last", "last_open", "last_bare", "last_dangling", "item", "code", "short", "first", "only", "echo_part", "denies", "speaks", "unknown", "ended", "after_code", "closed", "last_item")
DEFECTS = ("empty", "refusal", "copied", "other_language", "truncated")

#: How a responder declines, by language.
REFUSALS = {
    "en": r"\b(?:can(?:no|')?t|can not|cannot|am not able to|'m not able to|am unable to|'m unable to|won't be able to|will not|won't|would rather not|would prefer not to|must decline to|not permitted to|not allowed to|not in a position to)\s+(?:\w+\s+){0,2}?(?:help|assist|answer|respond|reply|provide|discuss|comply|fulfil|fulfill|do (?:that|this|so)|support|share|talk|engage|continue|give|complete|write|offer|take)\b|\b(?:have to|must|need to|will|going to) decline\b|\bi decline\b|\bagainst (?:the|my|our) (?:rules|polic\w+|guidelines|principles)|\bnot (?:something )?(?:i am |i'm )?comfortable\b|\bno answer can be given\b|\b(?:do not|don't) have access to\b|\bleave this to (?:a|an|the) \w+|\bnot (?:able|authori[sz]ed|permitted|allowed) to (?:answer|discuss|provide|help|assist|respond|share)",
    "de": r"\b(?:kann|darf|möchte|werde) (?:ich )?(?:\w+ ){0,5}nicht (?:\w+ ){0,3}(?:helfen|beantworten|äußern|antworten|weiterhelfen|besprechen|bereitstellen|erfüllen|liefern)|\bnicht (?:befugt|berechtigt|in der lage)\b|\bmuss ich ablehnen|\blehne ich ab",
    "fr": r"\bne (?:peux|puis|suis) pas (?:\w+ ){0,4}(?:répondre|aider|traiter|fournir|autorisé|en mesure|discuter)|\b(?:préfère|souhaite) ne pas|\bje (?:dois|préfère) (?:refuser|décliner)|\bn'ai pas le droit",
    "es": r"\bno (?:puedo|debo|me es posible|estoy autorizad\w+|se me permite) (?:\w+ ){0,4}(?:ayudar|responder|proporcionar|hablar|tratar|contestar|dar|hacer)|\bprefiero no\b|\b(?:debo|tengo que) (?:rechazar|declinar)|\bno estoy autorizad",
    "pt": r"\bnão (?:posso|devo|me é possível|estou autorizad\w+|tenho permissão) (?:\w+ ){0,4}(?:ajudar|responder|fornecer|falar|tratar|discutir|dar|fazer)|\bprefiro não\b|\b(?:devo|tenho de|tenho que) (?:recusar|declinar)|\bnão estou autorizad",
    "ru": r"\bне (?:могу|буду|вправе|имею права|готов)\b.{0,40}(?:помоч|ответ|отвеч|обсужд|предостав|говорить|дать)|\bмне нельзя\b|\bпредпочту не\b|\bпредпочитаю не\b|\bвынужден\w* отказать",
    "zh": r"(?:无法|不能|不便|不可以|没办法|拒绝|不会)[^，。]{0,8}(?:回答|提供|讨论|帮助|协助|谈论|完成|满足|处理)",
    "ja": r"(?:お手伝い|お答え|お話し?|回答|対応|提供|ご案内|お応え)(?:は|が|を|に|する|し|こと|は|いた|\w){0,8}(?:できません|できかねます|致しかねます|いたしかねます|控え|出来ません)|お断り",
}
#: Idioms that look like declining.
IDIOMS = r"overstate|over-?emphasi|emphasi[sz]e enough|stress enough|help but|thank you enough|recommend (?:\w+ )?enough|say enough"
#: Courtesies that go with declining.
COURTESIES = r"\b(?:sorry|apologi[sz]e|unfortunately|regrettably|as an ai|language model|to be honest|thanks for asking|i hope you understand|let us talk about something else|please ask someone|anything else you would like|leider|tut mir leid|als sprachmodell|désolé|malheureusement|en tant que modèle|lo siento|lamento|desafortunadamente|modelo de lenguaje|infelizmente|desculp\w+|modelo de linguagem|извините|к сожалению|языковая модель|простите)\b|抱歉|遗憾|对不起|作为语言模型|申し訳|残念ながら|言語モデルとして"
#: Names of the languages in these languages.
LANGUAGES = {
    "en": r"english|englisch\w*|anglais|ingl[eé]s|inglês|английск\w+|英语|英文|英語", "de": r"german|deutsch\w*|allemand|alem[aá]n|alemão|немецк\w+|德语|德文|ドイツ語", "fr": r"french|französisch\w*|français|franc[eé]s|francês|французск\w+|法语|法文|フランス語", "es": r"spanish|spanisch\w*|espagnol|español|espanhol|испанск\w+|西班牙语|スペイン語",
    "pt": r"portuguese|portugiesisch\w*|portugais|portugu[eé]s|português|португальск\w+|葡萄牙语|ポルトガル語", "ru": r"russian|russisch\w*|russe|ruso|russo|русск\w+|俄语|ロシア語", "zh": r"chinese|mandarin|chinesisch\w*|chinois|chino|chinês|китайск\w+|中文|汉语|中国語", "ja": r"japanese|japanisch\w*|japonais|japon[eé]s|japonês|японск\w+|日语|日文|日本語"}
#: Stand-ins for no answer.
STAND_INS = frozenset(("null", "nil", "n/a", "na", "todo", "tbd", "undefined", "nan", "output", "answer", "response", "result", "solution", "antwort", "respuesta", "resposta", "réponse", "ответ", "回答", "答案", "答え"))

#: Words of denying and of speaking of oneself, by which the field weighs clauses that no known form of declining matches.
DENIALS = frozenset("not no never none cannot unable nothing nicht kein keine keinen nie ne pas jamais nunca não не нет нельзя decline refuse".split())
SELVES = frozenset("i i'm i'd i've i'll me my we our ich mir mein meine je mon moi yo mi eu meu я мне меня мы".split())
CJK_DENIALS, CJK_SELVES = re.compile("[不无没未]|ません|できない"), re.compile("[我私]")

_BY_SCRIPT = {"cjk": re.compile("|".join(REFUSALS[k] for k in ("zh", "ja"))), "cyrillic": re.compile(REFUSALS["ru"], re.I), "latin": re.compile("|".join(f"(?:{REFUSALS[k]})" for k in ("en", "de", "fr", "es", "pt")), re.I)}
#: One of these is part of each courtesy, and one of the others of each form of declining.
_POLITE = ("sorry", "apolog", "fortunately", "regrettably", "as an ai", "language model", "honest", "thanks", "i hope", "let us talk", "please ask", "anything else", "leider", "tut mir leid", "als sprachmodell", "désolé", "malheureusement", "modèle", "lo siento", "lamento", "afortunadamente", "modelo", "infelizmente", "desculp", "извините", "к сожалению", "языковая", "простите", "抱歉", "遗憾", "对不起", "模型", "申し訳", "残念", "モデル")
_HINTS = ("n't", "not", "won", "cant ", "decline", "against", "no answer", "leave this", "nicht", "lehne", "ablehnen", "ne ", "pas", "préfère", "souhaite", "refuser", "décliner", "no ", "prefiero", "rechazar", "declinar", "não", "prefiro", "recusar", "не", "предп", "отказ", "нельзя", "无法", "不", "没办法", "拒绝", "ません", "かねます", "控え", "出来", "お断り")
_IDIOM, _COURTESY = re.compile(IDIOMS, re.I), re.compile(COURTESIES, re.I)
_NAMES = {k: re.compile(rf"(?<!\w)(?:{p})(?!\w)" if k not in ("zh", "ja") else p, re.I) for k, p in LANGUAGES.items()}
_ANY_NAME = re.compile("|".join(LANGUAGES.values()), re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_HAN, _KANA, _CYR = re.compile("[㐀-鿿]"), re.compile("[぀-ヿ]"), re.compile("[Ѐ-ӿ]")
_TAG = re.compile(r"^\s*\[(/?)([A-Z][A-Z_ ]{1,20})\]\s*$", re.M)
_BREAK_END = re.compile(r"<br\s*/?>$", re.I)
_CLOSED = re.compile(r"\[/[A-Z][A-Z_ ]{1,20}\]\s*$")
_ITEM = re.compile(r"^\s*(?:[-*+•◦]|\(?\w{1,3}[.)]|\[[ xX]\])\s+\S")
_SPLIT = re.compile(r"(?<=[.!?…])[\"'”»)\]]*\s+|(?<=[。！？])[」』”]*\s*")
_END = re.compile(r"[.!?。！？…:;：]['\"”’»)\]」』*_`]*$")
_FENCE = re.compile(r"```[^\n]*\n?(.*?)(?:```|\Z)", re.S)
_INVISIBLE = re.compile(r"[​-‏‪-‮⁠-⁤﻿­]")
_MARKUP = re.compile(r"<[^<>\n]{1,80}>|&(?:nbsp|#\d+|#x[0-9a-f]+);", re.I)
_TIGHT = re.compile(r"[\W_]+")


class Languages:
    """The language of a piece of prose by script and by the languages' common words."""

    def __init__(self, common: dict[str, list[str]]):
        self.of: dict[str, list[str]] = {}
        for lang, words in common.items():
            for w in words:
                self.of.setdefault(w, []).append(lang)

    def votes(self, text: str, words: list[str]) -> tuple[int, int, int, int, int, dict[str, float]]:
        """(Han, kana, Cyrillic, letters, words, votes of the languages' common words); those of a whole are the sums of its parts."""
        han = kana = cyr = 0
        if not text.isascii():
            han, kana, cyr = (len(p.findall(text)) for p in (_HAN, _KANA, _CYR))
        votes: dict[str, float] = {}
        get = self.of.get
        for w in words:
            if own := get(w):
                for lang in own:
                    votes[lang] = votes.get(lang, 0) + 1 / len(own)
        return han, kana, cyr, sum(map(len, words)), len(words), votes

    def decide(self, parts: list[tuple[int, int, int, int, int, dict[str, float]]]) -> str | None:
        han, kana, cyr, letters, n = parts[0][:5] if len(parts) == 1 else (sum(p[i] for p in parts) for i in range(5))
        if han + kana > letters * 0.4:
            return "ja" if kana > 0.05 * (han + kana) else "zh"
        if cyr > letters * 0.5:
            return "ru"
        votes: dict[str, float] = {}
        for p in parts:
            for k, v in p[5].items():
                votes[k] = votes.get(k, 0) + v
        if not votes:
            return None
        if len(votes) == 1:
            best, second = next(iter(votes)), 0
        else:
            second, best = sorted(votes.values())[-2], max(sorted(votes), key=votes.get)
        return best if votes[best] >= 1 and votes[best] > second * 1.15 and votes[best] >= 0.08 * n else None

    def __call__(self, text: str) -> str | None:
        return self.decide([self.votes(text, _WORD.findall(text.lower()))])

    def is_common(self, word: str) -> bool:
        return word in self.of


def _tight(text: str) -> str:
    return _TIGHT.sub("", text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).casefold())


def clauses(text: str) -> list[tuple[str, str, bool]]:
    """(clause, kind, open): kind is text, item or code; open: a code block or marked section that isn't closed."""
    out: list[tuple[str, str, bool]] = []
    opened = None
    for m in _TAG.finditer(text):
        opened = m[2] if not m[1] else None if opened == m[2] else opened
    plain = _TAG.sub("\n", text)
    at = 0

    def prose(part: str) -> None:
        for line in part.split("\n"):
            if _ITEM.match(line):
                out.append((line, "item", False))
            else:
                out.extend((c, "text", False) for c in _SPLIT.split(line) if c and c.strip())

    for m in _FENCE.finditer(plain):
        prose(plain[at : m.start()])
        if m[1].strip() or not m[0].endswith("```"):
            out.append((m[1].strip(), "code", not (m[0].endswith("```") and len(m[0]) > 3)))
        at = m.end()
    prose(plain[at:])
    if opened and out:
        out[-1] = (*out[-1][:2], True)
    return out


def blank(text: str | None) -> bool:
    """Whether nothing is there that could answer."""
    if text is None:
        return True
    t = re.sub(r"```\w*", " ", text) if "```" in text else text
    t = _TAG.sub(" ", t) if "[" in t else t
    t = _MARKUP.sub(" ", t) if "<" in t or "&" in t else t
    t = t if t.isascii() else _INVISIBLE.sub("", t)
    t = t.strip().strip("\"'`*_:#-=>").strip()
    return not any(c.isalnum() for c in t) or t.lower() in STAND_INS


def features(prompt: str, output: str, langs: Languages) -> tuple[np.ndarray, list[int]]:
    """(clauses x FEATURES, clause lengths)."""
    text = (output if output.isascii() else _INVISIBLE.sub("", output)).replace("\r\n", "\n").rstrip()
    while text.endswith(">") and (m := _BREAK_END.search(text, max(0, len(text) - 12))):
        text = text[: m.start()].rstrip()
    parts = clauses(text)
    tight = _tight(prompt)
    grams = {tight[i : i + 4] for i in range(max(1, len(tight) - 3))}
    named = {k for k, p in _NAMES.items() if p.search(prompt)} if _ANY_NAME.search(prompt) else set()
    own = langs(prompt)
    allowed = named | ({own} if own else set())
    found = [_WORD.findall(c) for c, _, _ in parts]
    lower = [[w.lower() for w in ws] for ws in found]
    votes = [langs.votes(c, ws) if k == "text" else None for (c, k, _), ws in zip(parts, lower)]
    whole = langs.decide([v for v in votes if v])
    closed = bool(_CLOSED.search(text))
    rows, sizes = [], []
    for i, (c, kind, is_open) in enumerate(parts):
        t = _tight(c)
        n = max(1, len(t) - 3)
        hit = 0
        if t and tight:
            hit = int(t == tight) if len(t) < 4 else n if t in tight else sum(map(grams.__contains__, [t[j : j + 4] for j in range(n)]))
        echo = hit / n
        words, vote = found[i], votes[i]
        cjk = vote[0] + vote[1] if vote else 0 if c.isascii() else len(_HAN.findall(c)) + len(_KANA.findall(c))
        size = len(t) // 2 if cjk else len(words)
        lang = langs.decide([vote]) if vote else None
        foreign = vote is not None and bool(allowed) and (lang or whole) not in allowed and (lang or whole) is not None and size >= 5
        last = i == len(parts) - 1
        ended = kind != "text" or bool(_END.search(c.strip()))
        dangling = last and not ended and bool(words) and (c.rstrip().endswith((",", "，", "、", "-", "(")) or langs.is_common(words[-1].lower()) or (size > 2 and (t[-1:] in ("は", "の", "を", "に", "が", "で", "と", "和", "的", "在", "了", "着"))))
        low = c.lower() if kind != "code" else ""
        denies = bool(low) and (not DENIALS.isdisjoint(lower[i]) or "n't" in low or bool(cjk and CJK_DENIALS.search(c)))
        speaks = denies and (not SELVES.isdisjoint(lower[i]) or bool(cjk and CJK_SELVES.search(c)))
        form = _BY_SCRIPT["cjk" if cjk else "cyrillic" if vote and vote[2] else "latin"]
        declines = any(h in low for h in _HINTS) and bool(form.search(c)) and not _IDIOM.search(c)
        bare = last and not ended and (size > 4 or size > 0 and i > 0 and parts[i - 1][1] == "text" and bool(_END.search(parts[i - 1][0].strip())))
        rows.append((1.0, declines, any(h in low for h in _POLITE) and bool(_COURTESY.search(c)), echo > 0.85, foreign, last, last and is_open, bare, dangling, kind == "item", kind == "code", size <= 4, i == 0, len(parts) == 1, 0.5 < echo <= 0.85, denies, speaks, vote is not None and lang is None, ended, i > 0 and parts[i - 1][1] == "code", last and closed, last and kind == "item"))
        sizes.append(max(1, len(t)))
    return np.array(rows, dtype=float).reshape(-1, len(FEATURES)), sizes


class Field:
    """A linear-chain conditional random field over TAGS."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    def tag(self, x: np.ndarray) -> list[int]:
        if not len(x):
            return []
        s = x @ self.emit
        back, best = [], s[0]
        for row in s[1:]:
            t = best[:, None] + self.move
            back.append(t.argmax(0))
            best = t.max(0) + row
        out = [int(best.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]

    @classmethod
    def fit(cls, xs: list[np.ndarray], ys: list[list[int]], rounds: int = 150, l2: float = 1e-3, rate: float = 0.1) -> Field:
        n, k, d, t = len(xs), len(TAGS), len(FEATURES), max(map(len, xs))
        x, y, m = np.zeros((n, t, d)), np.zeros((n, t), int), np.zeros((n, t), bool)
        for i, (a, b) in enumerate(zip(xs, ys)):
            x[i, : len(a)], y[i, : len(b)], m[i, : len(a)] = a, b, True
        emit, move = np.zeros((d, k)), np.zeros((k, k))
        gold = np.eye(k)[y] * m[:, :, None]
        want_e = np.einsum("ntd,ntk->dk", x, gold)
        want_m = np.einsum("ntj,ntk->jk", gold[:, :-1], gold[:, 1:])
        m1 = [np.zeros_like(emit), np.zeros_like(move)]
        m2 = [np.zeros_like(emit), np.zeros_like(move)]
        on = m[:, :, None]
        for step in range(1, rounds + 1):
            # forward and backward probabilities, scaled to 1 at each clause; past its end a pair's stay as they are
            s = x @ emit
            b = np.exp(s - s.max(2, keepdims=True))
            go = np.exp(move)
            alpha, beta, scale = np.empty((n, t, k)), np.ones((n, t, k)), np.ones((n, t, 1))
            alpha[:, 0] = b[:, 0]
            for i in range(t):
                if i:
                    alpha[:, i] = np.where(on[:, i], (alpha[:, i - 1] @ go) * b[:, i], alpha[:, i - 1])
                scale[:, i] = alpha[:, i].sum(1, keepdims=True)
                alpha[:, i] /= scale[:, i]
            for i in range(t - 2, -1, -1):
                beta[:, i] = np.where(on[:, i + 1], ((b[:, i + 1] * beta[:, i + 1]) @ go.T) / scale[:, i + 1], beta[:, i + 1])
            p = alpha * beta
            p = p / p.sum(2, keepdims=True) * on
            ge = want_e - np.einsum("ntd,ntk->dk", x, p, optimize=True)
            pair = (alpha[:, :-1] * on[:, 1:]).reshape(-1, k).T @ (b[:, 1:] * beta[:, 1:] / scale[:, 1:] * on[:, 1:]).reshape(-1, k) * go
            gm = want_m - pair
            for q, (w, g) in enumerate(((emit, ge / n - l2 * emit), (move, gm / n - l2 * move))):
                m1[q] = 0.9 * m1[q] + 0.1 * g
                m2[q] = 0.99 * m2[q] + 0.01 * g * g
                w += rate * (m1[q] / (1 - 0.9**step)) / (np.sqrt(m2[q] / (1 - 0.99**step)) + 1e-8)
        return cls(emit, move)


def labelled_pairs(common: dict[str, list[str]], n: int = TRAIN_PAIRS, seed: int = 5) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """(prompt, pieces of its response as (text, tag)): made pairs, half of them sound. A piece's tag says how it was made."""
    r = random.Random(seed)
    langs = sorted(common)
    cjk = ("zh", "ja")

    def made(lang: str) -> str:
        if lang in cjk:
            return "".join(chr(r.randint(0x4E00, 0x8FFF)) for _ in range(2)) + ("は" if lang == "ja" else "")
        h, v = ("бвгджзклмнпрст", "аеио") if lang == "ru" else ("bcdfghklmnprst", "aeiou")
        return "".join(r.choice(h) + r.choice(v) for _ in range(r.randint(2, 4)))

    def sentence(lang: str, end: str = ".") -> str:
        w = [r.choice(common[lang]) if r.random() < 0.35 else made(lang) for _ in range(r.randint(7, 15))]
        return "".join(w) + ("。" if end == "." else "？") if lang in cjk else " ".join(w).capitalize() + end

    declines = {"en": ["I cannot help with that request.", "I have to decline.", "That goes against my guidelines.", "I am not able to provide this.", "No answer will come from me on this matter.", "This is nothing that I would talk of.", "I must leave this to an expert.", "That is against the rules here."], "de": ["Dabei kann ich nicht helfen.", "Dazu sage ich nichts, das geht nicht."], "fr": ["Je ne peux pas répondre.", "Je préfère ne pas en parler."], "es": ["No puedo ayudar con eso.", "De eso yo no hablo."], "pt": ["Não posso ajudar com isso.", "Disso eu não falo."], "ru": ["Я не могу помочь с этим.", "Об этом я не говорю."], "zh": ["我无法回答这个问题。", "这件事我不谈。"], "ja": ["その質問にはお答えできません。", "この話はできません。"]}
    sorry = {"en": ["Sorry, ", "As an AI language model, ", ""], "zh": ["抱歉，", ""], "de": ["Leider: ", ""]}
    names = {"en": "English", "de": "German", "fr": "French", "es": "Spanish", "pt": "Portuguese", "ru": "Russian", "zh": "Chinese", "ja": "Japanese"}

    def changed(prompt: str) -> str:
        w = prompt.split()
        if len(w) > 5 and r.random() < 0.5:
            k = r.randrange(len(w))
            w = w[:k] + ([made("en")] if r.random() < 0.4 else []) + w[k + 1 :]
            return " ".join(w)
        return r.choice([prompt, prompt.lower(), f'"{prompt}"', f"{prompt}\n{prompt}", prompt.rstrip(".?。？"), prompt.upper()])

    def phrase(lang: str) -> str:
        return ("" if lang in cjk else " ").join(r.choice(common[lang]) if r.random() < 0.3 else made(lang) for _ in range(r.randint(1, 6)))

    def statement() -> str:
        return r.choice([f"assert {made('en')} == {r.randint(1, 999)}", f"{made('en')}({r.randint(1, 9)})", f"{made('en')} = {made('en')} + {r.randint(1, 9)};"])

    def sound(lang: str, body: list[str], code: str, sep: str) -> str:
        return r.choice([sep.join(body)] * 4 + ["[THOUGHT]\n" + sep.join(body) + "\n[/THOUGHT]\n[ANSWER]\n" + statement() + "\n[/ANSWER]", "[THOUGHT]\n" + sep.join(body) + "\n[/THOUGHT]\n[ANSWER]\n" + phrase(lang) + "\n[/ANSWER]", "\n".join(f"{j + 1}. {phrase(lang)}" for j in range(r.randint(2, 6))), "\n".join(f"- {phrase(lang)}" for _ in range(r.randint(2, 6))), body[0] + "\n" + "\n".join(f"- {phrase(lang)}" for _ in range(3)), phrase(lang), code, code + "\n" + body[0], made(lang), f"{r.randint(1, 99)} {made(lang)}", "\n".join(f"{j + 1}. {made(lang)}" for j in range(4)), ", ".join(made(lang) for _ in range(3)), "I cannot overstate how much this matters here. " + sentence("en"), "We do not know it for sure, and I would not say so. " + sentence("en"), "[THOUGHT]\n" + body[0] + "\n[/THOUGHT]\n[ANSWER]\n" + body[-1] + "\n[/ANSWER]"])

    for i in range(n):
        lang = "en" if r.random() < 0.5 and "en" in common else r.choice(langs)
        sep = "" if lang in cjk else " "
        prompt = sentence(lang, r.choice(".?"))
        body = [sentence(lang) for _ in range(r.randint(1, 5))]
        code = "```python\n" + "\n".join(f"{made('en')} = {made('en')}({r.randint(1, 9)})" for _ in range(4)) + "\n```"
        how = i % 8
        if how in (0, 1):
            if r.random() < 0.1 and len(langs) > 1:
                other = r.choice([x for x in langs if x in names and x != lang] or [lang])
                yield f"Translate into {names.get(other, other)}: {prompt}", [(" ".join(sentence(other) for _ in body), "answer")]
            else:
                yield prompt, [(sound(lang, body, code, sep), "answer")]
        elif how == 2:
            yield prompt, [(changed(prompt), "echo"), (r.choice([" ", "\n\n"]), "answer"), (sep.join(body), "answer")]
        elif how == 3:
            yield prompt, [(r.choice(sorry.get(lang, [""])) + r.choice(declines.get(lang, declines["en"])) + r.choice(["", " I hope you understand."]), "refusal"), (r.choice(["", sep + body[0]]), "answer")]
        elif how == 4:
            yield prompt, [(changed(prompt), "echo")]
        elif how == 5:
            other = r.choice([x for x in langs if x != lang] or [lang])
            yield prompt, [(("" if other in cjk else " ").join(sentence(other) for _ in body), "foreign")]
        else:
            kind = r.random()
            if kind < 0.2:
                yield prompt, [(r.choice(["", body[0] + "\n"]), "answer"), (code[: -r.randint(3, 12)], "unfinished")]
            elif kind < 0.35:
                yield prompt, [("[THOUGHT]\n" + body[0] + "\n[/THOUGHT]\n", "answer"), ("[ANSWER]\n" + sentence(lang), "unfinished")]
            else:
                end = sentence(lang)
                cut = end[: max(4, int(len(end) * r.uniform(0.2, 0.95)))].rstrip(".。 ")
                yield prompt, [(sep.join(body) + sep if r.random() < 0.8 else "", "answer"), (cut + r.choice(["", "", ","]), "unfinished")]


def tags_as_made(pieces: list[tuple[str, str]]) -> list[int]:
    """The tag of each clause of the response: that of the piece that it begins in."""
    text = "".join(p for p, _ in pieces)
    ends = np.cumsum([len(p) for p, _ in pieces])
    out, at = [], 0
    for c, _, _ in clauses(text):
        head = c.strip()[:24]
        at = max(at, text.find(head, at))
        out.append(TAGS.index(pieces[int(np.searchsorted(ends, at, "right"))][1]))
        at += len(head)
    return out


@lru_cache(maxsize=4)
def _fitted(words: tuple[tuple[str, tuple[str, ...]], ...], n: int) -> Field:
    common = {k: list(v) for k, v in words}
    langs = Languages(common)
    xs, ys = [], []
    for prompt, pieces in labelled_pairs(common, n):
        x, _ = features(prompt, "".join(p for p, _ in pieces), langs)
        y = tags_as_made(pieces)
        if 0 < len(x) == len(y) <= 12:
            xs.append(x)
            ys.append(y)
    return Field.fit(xs, ys)


def fitted(common: dict[str, list[str]], n: int = TRAIN_PAIRS) -> Field:
    return _fitted(tuple((k, tuple(v)) for k, v in sorted(common.items())), n)


def defect(prompt: str | None, output: str | None, field: Field, langs: Languages) -> tuple[str | None, list[float]]:
    """The pair's defect, or None, and the share of each tag in the response."""
    share = [0.0] * len(TAGS)
    if blank(output):
        return "empty", share
    x, sizes = features(prompt or "", output, langs)
    tags = field.tag(x)
    if not tags:
        return "empty", share
    for t, s in zip(tags, sizes):
        share[t] += s / sum(sizes)
    part = dict(zip(TAGS, share))
    if (tags[0] == 1 and any(x[i, 1] for i, t in enumerate(tags) if t == 1)) or part["refusal"] > 0.5:
        return "refusal", share
    # an exact check: the whole response adds next to nothing to the prompt
    a, b = _tight(prompt or ""), _tight(output)
    if part["echo"] + part["unfinished"] > 0.9 and part["echo"] > 0 or (a and b and (b == a or b in a and len(b) > 0.6 * len(a) or b.replace(a, "") == "" and a in b)):
        return "copied", share
    if part["foreign"] > 0.5:
        return "other_language", share
    return ("truncated" if tags[-1] == TAGS.index("unfinished") else None), share


def tag_pairs(pairs: DataFrame, common: dict[str, list[str]], key: str = "pair_id", instruction: str = "instruction", fallback: str | None = "input", output: str = "output") -> DataFrame:
    """(key, defect, n_clauses-free shares answer, refusal, echo, foreign, unfinished) of each row."""
    require(pairs, key, instruction, output, *([fallback] if fallback else []))
    text = F.col(instruction)
    if fallback:
        text = F.when(F.length(F.trim(F.regexp_replace(F.coalesce(F.col(instruction), F.lit("")), r"[\s ​　]", ""))) > 0, F.col(instruction)).otherwise(F.col(fallback))
    field, langs = fitted(common), Languages(common)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [defect(p, o, field, langs) for p, o in zip(b["_p"].where(b["_p"].notna(), None), b["_o"].where(b["_o"].notna(), None))]
            yield pd.DataFrame({"_k": b["_k"], "defect": [d for d, _ in got], **{t: [s[i] for _, s in got] for i, t in enumerate(TAGS)}})

    src = spread(pairs.select(F.col(key).alias("_k"), text.alias("_p"), F.col(output).alias("_o")))
    return src.mapInPandas(run, f"_k {pairs.schema[key].dataType.simpleString()}, defect string, " + ", ".join(f"{t} double" for t in TAGS)).withColumnRenamed("_k", key)


def defects(pairs: DataFrame, common: dict[str, list[str]], **names: str | None) -> DataFrame:
    """(key, defect): one row a defective pair."""
    key = names.get("key", "pair_id")
    order = F.array_position(F.array(*map(F.lit, DEFECTS)), F.col("defect"))
    return tag_pairs(pairs, common, **names).filter("defect IS NOT NULL").groupBy(key).agg(F.min_by("defect", order).alias("defect"))


def found_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    common = common_words(spark, sf_dir)
    one = lambda name, fb: defects(table(spark, sf_dir, name), common, fallback=fb).select(F.lit(name).alias("table_name"), "pair_id", "defect")
    return one("raw_code", "input").unionByName(one("pipeline_general", None))


def rates_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_query(spark, sf_dir).groupBy("table_name", "defect").agg(F.count("*").alias("n_pairs"))
