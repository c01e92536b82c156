"""Problem 7: files that aren't valid in the language they state.

Method: parsing with derivatives. A language is a grammar whose productions each begin with a token (Greibach form), so the
derivative of what may still come by the next token is the union of the tails of all productions that begin with it, also of
those behind nonterminals that may be empty. A state is the set of all that may still come: interned linked lists of nonterminals;
derivatives are memoised by (state, token), across all files of a worker. An empty derivative is an error at exactly that
token; a state at the end of the text that isn't nullable means that the text was cut off.

Each language has a lexer that gives token classes (also for line ends and indentation where they matter) and a grammar
built from tables: which class may follow which within a block, parentheses, the head of a loop, brackets or an initialiser; where
a brace may open a block or a value, both stay open until the tokens decide. The grammars accept some invalid programs, never knowingly
a valid one less. For Python and JSON the language's own parser then checks the texts that the grammar accepts. A null language
falls back on the file's ending; languages without a grammar are not judged. Null and blank texts are no cases.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.runtime import require, spread, table

#: Spellings and endings of the languages.
SPELLINGS = {"python": ("python", "python3", "py", "py3", "python 3", "cpython"), "javascript": ("javascript", "js", "node", "nodejs", "ecmascript", "jsx"), "java": ("java",), "c": ("c", "h", "c99", "c11", "ansi c"), "go": ("go", "golang"), "json": ("json",), "yaml": ("yaml", "yml"), "shell": ("shell", "sh", "bash", "shellscript", "posix shell")}
ENDINGS = {".py": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript", ".java": "java", ".c": "c", ".h": "c", ".go": "go", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".sh": "shell", ".bash": "shell"}
_BY_SPELLING = {s: k for k, v in SPELLINGS.items() for s in v}


def language_of(language: str | None, path: str | None) -> str | None:
    if language and language.strip():
        return _BY_SPELLING.get(language.strip().lower())
    p = (path or "").strip().lower()
    for cut in (".bak", ".orig", ".txt", "~", ".old"):
        p = p.removesuffix(cut)
    return next((v for k, v in ENDINGS.items() if p.endswith(k)), None)


# --- derivatives


Stack = tuple  # () or (nonterminal, Stack)
State = tuple  # of Stacks; () is the empty derivative


class Grammar:
    """Productions by nonterminal and first token: a tail of nonterminals, or a list of such tails; a nonterminal in `empty` may also derive nothing."""

    MOST = 400_000

    def __init__(self, start: object, rules: dict[object, dict[str, tuple | list]], empty: set):
        self.start, self.empty = start, empty
        self.rules = {n: {t: tails if isinstance(tails, list) else [tails] for t, tails in by.items()} for n, by in rules.items()}
        self.lists: dict[tuple, Stack] = {}
        self.states: dict[frozenset, State] = {}
        self.memo: dict[tuple[int, str], State] = {}

    def cons(self, head: object, tail: Stack) -> Stack:
        """An interned list: equal ones are one object."""
        key = (head, id(tail))
        got = self.lists.get(key)
        if got is None:
            got = self.lists[key] = (head, tail)
        return got

    def state(self, stacks: list[Stack]) -> State:
        """The interned set of these lists."""
        key = frozenset(map(id, stacks))
        got = self.states.get(key)
        if got is None:
            got = self.states[key] = tuple({id(x): x for x in stacks}.values())
        return got

    def derive(self, state: State, token: str) -> State:
        """The state after token."""
        out: list[Stack] = []
        for at in state:
            while at:
                for tails in self.rules[at[0]].get(token, ()):
                    new = at[1]
                    for n in reversed(tails):
                        new = self.cons(n, new)
                    out.append(new)
                if at[0] not in self.empty:
                    break
                at = at[1]
        got = self.memo[(id(state), token)] = self.state(out)
        return got

    def nullable(self, state: State) -> bool:
        for at in state:
            while at and at[0] in self.empty:
                at = at[1]
            if not at:
                return True
        return False

    def check(self, tokens: list[str]) -> int | None:
        """None if the tokens are a sentence; else the index of the failing token, or their number if the end comes too soon."""
        if len(self.lists) > self.MOST or len(self.memo) > self.MOST:
            # states live as long as their tables, so that an id always names the same one
            self.lists.clear(), self.states.clear(), self.memo.clear()
        state = self.state([self.cons(self.start, ())])
        get = self.memo.get
        for i, t in enumerate(tokens):
            nxt = get((id(state), t))
            if nxt is None:
                nxt = self.derive(state, t)
            if not nxt:
                return i
            state = nxt
        return None if self.nullable(state) else len(tokens)


#: Classes after which an operand is complete, and those that need one.
_OPENERS = {"(": ")", "[": "]", "{": "}"}


def bracket_grammar(follow: dict[str, set[str]], block: dict[str, tuple[str, ...]], may_end: dict[str, set[str]], heads: dict[str, str], not_in: dict[str, set[str]]) -> Grammar:
    """A grammar of nested contexts. A nonterminal (context, last class) says what may follow within the context.

    follow: by class, the classes that may come next. block: by the class before `{`, the contexts that it may open.
    may_end: by context, the classes after which its closing bracket may come. heads: by the class before `(`, the context that it
    opens, else P, which has no semicolon. S has any number of them; the head of a loop has none (F0) or two (F2), and between them is F1. not_in: by context, the classes that it never has.
    """
    close = {"P": ")", "S": ")", "F0": ")", "F1": ")", "F2": ")", "K": "]", "B": "}", "I": "}", "L": "}"}
    may_end = {"S": may_end["P"], "F0": may_end["P"], "F2": may_end["P"]} | may_end
    rules: dict[object, dict[str, tuple]] = {}
    empty: set = set()
    classes = set(follow)
    for ctx in ("F", *close):
        for last in classes | {"^"}:
            out: dict[str, tuple] = {}
            for t in follow[last] - not_in.get(ctx, set()):
                if t in (")", "]", "}"):
                    continue
                if t in _OPENERS:
                    inner = (heads.get(last, "P"),) if t == "(" else ("K",) if t == "[" else block.get(last if not (ctx == "I" and last in ("^", ",")) else "=", ("L",))
                    out[t] = [((x, "^"), (ctx, _OPENERS[t])) for x in inner]
                elif t == ";" and ctx in ("P", "F0", "F1", "F2"):
                    if ctx in ("F0", "F1"):
                        out[t] = (("F1" if ctx == "F0" else "F2", ";"),)
                else:
                    out[t] = ((ctx, t),)
            if ctx == "F":
                if last == "^" or last in may_end["F"]:
                    empty.add((ctx, last))
            elif ctx in may_end and (last == "^" and ctx != "F0" or last in may_end[ctx]):
                out[close[ctx]] = ()
            rules[(ctx, last)] = out
    return Grammar(("F", "^"), rules, empty)


def _tables(lang: str) -> Grammar:
    operand = {"id", "num", "str", "re"}
    starts = operand | {"kw", "kwc", "for", "try", "fn", "(", "[", "{", "sign", "pre", "inc", "at"}
    after = {"op", "sign", "=", "(", "[", ",", ";", ":", "?", ".", "arrow", "inc"}
    semi = lang in ("c", "java")
    follow: dict[str, set[str]] = {}
    follow["id"] = after | {"id", "{", "at", "fn"} | ({"kw"} if lang != "javascript" else {"kw"}) | ({"str"} if lang in ("go", "c") else set()) | ({"re"} if lang == "javascript" else set())
    follow["num"] = after
    follow["str"] = after | ({"str", "id"} if lang == "c" else set())
    follow["re"] = after
    follow[")"] = after | operand | {"kw", "kwc", "for", "try", "fn", "{", "pre", "at"}
    follow["]"] = after | {"id", "{", "kw", "fn"} | ({"str", "num"} if lang == "c" else set()) | ({"str"} if lang == "go" else set())
    follow["}"] = starts | after | ({"op", "id"})
    follow["op"] = starts - {"kwc", "for", "try", "at"}
    follow["sign"] = starts - {"kwc", "for", "try", "at"} | ({",", "="} if lang == "c" else set()) | ({"kw"})
    follow["="] = starts - {"kwc", "for", "try"}
    follow["pre"] = starts - {"kwc", "for", "try", "at"}
    follow["inc"] = after | operand | {"(", "{"}
    follow["."] = {"id", "kw", "fn", "(", "[", "sign", "kwc", "for", "try", "num"} if lang in ("javascript", "java", "go") else {"id", "num", "="}
    follow["."] |= {"op", "?"} if lang == "java" else set()
    follow[","] = starts - {"kwc", "for", "try"} | ({","} if lang == "javascript" else set()) | ({"."} if lang in ("c", "javascript") else set())
    follow["?"] = starts - {"kwc", "for", "try"} | {".", ":"} | ({"op", ")", ","} if lang == "java" else set())
    follow[":"] = starts | {";"}
    follow["arrow"] = starts - {"kwc", "for", "try"}
    follow["at"] = {"id", "kw"}
    follow[";"] = starts | {";"}
    follow["^"] = starts | {";"} | ({".", ","} if lang in ("javascript", "c", "java") else {"."})
    follow["kw"] = starts | {";", ":", "sign", "="} | ({"op", ",", "."} if lang in ("go", "java", "c", "javascript") else set())
    follow["fn"] = {"id", "(", "sign", "{", "[", ",", "kw", "op"}
    follow["kwc"] = {"("} if lang != "go" else starts | {";"}
    follow["for"] = {"("} | ({"kw"} if lang == "javascript" else set())
    follow["try"] = {"(", "{"}
    if lang == "go":
        follow["num"] |= {"{"}
        follow["str"] |= {"{"}
    done = operand | {")", "]", "}", "inc", "kw"}
    block: dict[str, tuple[str, ...]] = dict.fromkeys(follow, ("L",))
    if semi:
        block = dict.fromkeys(follow, ("B",)) | dict.fromkeys(("=", ",", "(", "]", "op"), ("I",))
        if lang == "c":
            block[")"] = ("B", "I")  # the body of a function, or a literal of the type in parentheses
    may_end = {"P": done | {";", "^"} | ({"sign"} if lang in ("c", "go") else set()) | ({","} if lang in ("go", "javascript") else set()) | ({"."} if lang in ("c", "go", "java", "javascript") else set()) | ({"op", "fn"} if lang in ("java", "go") else set()), "K": done | {"op", "^"} - {"op"} | ({","} if lang in ("go", "javascript") else set()) | ({"."} if lang == "go" else set()) | ({":"} if lang == "go" else set())}
    may_end["I"] = done | {","}
    may_end["B"] = {";", "}", "^", ":"}
    may_end["L"] = done | {",", ";", "^", ":", "fn"}
    may_end["F"] = {";", "}", "^"} | (done if lang in ("javascript", "go") else set()) | ({"id", ")", "str"} if lang == "c" else set())
    # a macro's arguments may hold semicolons, and those that line ends stand for are inserted in parentheses too
    heads = {"c": {"for": "F0", "id": "S"}, "java": {"for": "F0", "try": "S"}, "javascript": {"for": "F0", "kw": "F0"}, "go": dict.fromkeys(follow, "S")}[lang]
    not_in: dict[str, set[str]] = {}
    if lang == "c":  # a literal has no statements, and a loop no head of one part
        not_in["I"] = {"kw", "kwc", "for"}
        may_end["F0"] = set()
    return bracket_grammar(follow, block, may_end, heads, not_in)


_KWC = {"c": "if while for switch", "java": "if while for switch catch synchronized", "javascript": "if while for switch catch with", "go": ""}
_KW = {
    "c": "return else do break continue case default goto sizeof static const extern typedef struct union enum volatile register inline unsigned signed restrict",
    "java": "return else do try finally break continue case default throw throws new class interface enum extends implements static final public private protected abstract import package instanceof assert synchronized native transient volatile record sealed permits",
    "javascript": "return else do try finally break continue case default throw new class extends static import export from const let var in of instanceof typeof delete void await async yield get set debugger",
    "go": "return else break continue case default goto fallthrough defer go package import var const type struct interface map chan range select if for switch",
}
_SHARED = r"0[xXbBoO][0-9a-fA-F_]+[uUlLnN]*|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?[fFdDlLuUnij]*(?![\w])|[A-Za-z_$\u00a1-\u2fff\u3040-\ufaff\U00010000-\U0010ffff][\w$]*"
_OPS = {
    "c": r"->|\+\+|--|<<=|>>=|&&|\|\||[<>=!]=|<<|>>|[-+*/%&|^]=|\.\.\.|##?",
    "java": r"->|::|\+\+|--|>>>=|<<=|>>=|>>>|&&|\|\||[<>=!]=|<<|[-+*/%&|^]=|\.\.\.",
    "javascript": r"=>|\+\+|--|\*\*=?|>>>=?|<<=?|>>=?|[=!]==?|&&=?|\|\|=?|\?\?=?|\?\.(?!\d)|[<>]=|[-+*/%&|^]=|\.\.\.",
    "go": r":=|<-|\+\+|--|&\^=?|<<=?|>>=?|&&|\|\||[<>=!]=|[-+*/%&|^]=|\.\.\.",
}


@lru_cache(maxsize=8)
def _lexer(lang: str) -> re.Pattern:
    text = r'(?P<str>"(?:[^"\\\n]|\\[\s\S])*"|' + (r"'(?:[^'\\\n]|\\.)+'" if lang != "javascript" else r"'(?:[^'\\\n]|\\[\s\S])*'") + (r"|`[^`]*`" if lang == "go" else r"|`(?:[^`\\]|\\[\s\S])*`" if lang == "javascript" else r'|"""[\s\S]*?"""' if lang == "java" else "") + ")"
    if lang == "java":
        text = text.replace('(?P<str>', '(?P<str>"""[\\s\\S]*?"""|', 1)
    line = r"|^[ \t]*\#(?:[^\n\\]|\\[\s\S])*" if lang == "c" else ""
    return re.compile(r"(?P<skip>[ \t\r\f\v\u00a0\ufeff]+|//[^\n]*|/\*[\s\S]*?\*/" + line + r")|(?P<nl>\n)|" + text + r"|(?P<conflict>^(?:<{7}|>{7}|\|{7}|={7})(?:[ \n]|\Z))|(?P<word>" + _SHARED + r")|(?P<op>" + _OPS[lang] + r"|[-+*/%&|^~!<>=?:;,.@()\[\]{}#\\])|(?P<bad>[\s\S])", re.M)


_PUNCT = {c: c for c in "()[]{},;:?."} | {"=": "=", ":=": "=", "=>": "arrow", "@": "at", "++": "inc", "--": "inc", "!": "pre", "~": "pre", "...": "sign", "?.": ".", "::": ".", "<-": "sign", "->": "arrow"}
_SIGNS = frozenset("+-*&<^")
_GENERIC = re.compile(r"<(?:[\w\s,.?&\[\]]|<(?:[\w\s,.?&\[\]]|<[\w\s,.?\[\]]*>)*>)*>")
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_ENDS = frozenset(("id", "num", "str", "re", ")", "]", "}", "inc"))
_GO_ON = frozenset(("op", ".", "?", ":", ",", ")", "]", "=", "arrow", "sign", "{", "(", "["))


@lru_cache(maxsize=8)
def _words(lang: str) -> dict[str, str]:
    out = dict.fromkeys(_KW[lang].split(), "kw") | dict.fromkeys(_KWC[lang].split(), "kwc")
    if "for" in _KWC[lang].split():
        out["for"] = "for"
    if lang == "java":
        out["try"] = "try"
    if lang == "c":
        out["sizeof"] = "pre"
    if lang == "javascript":
        out["function"] = "fn"
    if lang == "go":
        out["func"] = "fn"
    return out


def lex(text: str, lang: str) -> tuple[list[str], list[int]]:
    """Token classes of a language with braces, and their places."""
    rx, words = _lexer(lang), _words(lang)
    out: list[str] = []
    at: list[int] = []
    pos, end, lines, depth = 0, len(text), lang in ("javascript", "go"), []
    match, newline = rx.match, False
    while pos < end:
        m = match(text, pos)
        kind, start, pos = m.lastgroup, pos, m.end()
        if kind == "skip":
            continue
        if kind == "nl":
            newline = True
            continue
        if kind == "word":
            w = m[0]
            c = "num" if w[0].isdigit() or w[0] == "." else words.get(w, "id")
            if c != "num" and out and out[-1] == ".":
                c = "id"
            elif c in ("kw", "kwc", "fn") and lang == "javascript" and text[pos : pos + 1] in (":", "(") and c == "kw" and w in ("get", "set", "of", "from", "async", "static", "default", "import", "await", "delete", "void", "typeof") and w not in ("default",):
                c = "id"
            elif lang == "java" and c == "id" and text[pos : pos + 1] == "<" and w[0].isupper() and (g := _GENERIC.match(text, pos)):
                pos = g.end()
        elif kind == "op":
            s = m[0]
            c = _PUNCT.get(s)
            if c is None:
                c = "sign" if s in _SIGNS and not (s == "<" and lang != "go") and not (s == "^" and lang != "go") else "op"
            if s == "*" and lang == "java" and out and out[-1] == ".":
                c = "id"
            if s == "->" and lang == "c":
                c = "."
            if s == "/" and lang == "javascript" and (not out or out[-1] not in _ENDS) and (g := _REGEX.match(text, start)):
                c, pos = "re", g.end()
            if s == "..." and lang in ("c", "java"):
                c = "id" if lang == "c" else "sign"
            if s == "<" and lang == "java" and (g := _GENERIC.match(text, start)) and (not out or out[-1] in ("kw", ".", ";", "{", "}")):
                pos = g.end()
                continue
        elif kind == "str":
            c = "str"
        else:
            c = "bad"
        if newline:
            newline = False
            if lines and out and (not depth or depth[-1] == "{" or lang == "go") and (out[-1] in _ENDS):
                if lang == "go" and c not in (")", "]", "}", ".") and (not depth or depth[-1] != "(" or c in ("id", "num", "str", "kw")):
                    out.append(";")
                    at.append(start)
                elif lang == "javascript" and c not in _GO_ON and c not in ("}", "inc"):
                    out.append(";")
                    at.append(start)
        if c in "([{":
            depth.append(c)
        elif c in ")]}" and depth:
            depth.pop()
        out.append(c)
        at.append(start)
    return out, at


# --- JSON, YAML, shell and Python

_JSON = re.compile(r'\s+|(?P<str>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<val>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|true\b|false\b|null\b)|(?P<p>[{}\[\],:])|(?P<bad>[\s\S])')


def _json_grammar() -> Grammar:
    value = {"str": (), "val": (), "{": ("members",), "[": ("items",)}
    rules = {"value": value, "members": {"}": (), "str": ("colon", "value", "more")}, "colon": {":": ()}, "more": {",": ("pair",), "}": ()}, "pair": {"str": ("colon", "value", "more")}, "items": {"]": ()} | {t: (*v, "next") for t, v in value.items()}, "next": {",": ("value", "next"), "]": ()}}
    return Grammar("value", rules, set())


def lex_json(text: str) -> tuple[list[str], list[int]]:
    out, at = [], []
    for m in _JSON.finditer(text.removeprefix("\ufeff")):
        if k := m.lastgroup:
            out.append(m[0] if k == "p" else k)
            at.append(m.start())
    return out, at


_SH_WORD = re.compile(r"(?:\\[\s\S]|'[^']*'|\"(?:[^\"\\]|\\[\s\S])*\"|\$\((?:[^()'\"]|'[^']*'|\"(?:[^\"\\]|\\[\s\S])*\"|\((?:[^()]|\([^()]*\))*\))*\)|\$\{[^}]*\}|`[^`]*`|[^\s;&|()<>'\"\\`$#]|(?<=[^\s])#|\$)+")
_SH_OP = re.compile(r"<<-?\s*(['\"]?)(\w+)\1|\d?>&\d?|&>|>>|<<<|\d?[<>]|;;|&&|\|\||[;&|()]|\n")
_SH_KEY = frozenset("if then elif else fi for while until do done case esac in { } ! function select".split())


def lex_shell(text: str) -> tuple[list[str], list[int]]:
    out, at, pos, end, command, here = [], [], 0, len(text), True, []
    text = text.replace("\r\n", "\n")
    end = len(text)
    while pos < end:
        c = text[pos]
        if c in " \t\r":
            pos += 1
            continue
        if text.startswith("\\\n", pos):
            pos += 2
            continue
        if c == "#":
            pos = text.find("\n", pos) if "\n" in text[pos:] else end
            continue
        if m := _SH_OP.match(text, pos):
            s = m[0]
            start, pos = pos, m.end()
            if s.startswith("<<") and m[2]:
                here.append(m[2])
                out.append("redirect"), at.append(start)
                out.append("word"), at.append(start)
                continue
            if s == "\n":
                while here:
                    stop = re.compile(rf"^[ \t]*{re.escape(here.pop(0))}[ \t]*$", re.M).search(text, pos)
                    if not stop:
                        return [*out, "bad"], [*at, pos]
                    pos = stop.end() + 1
                if re.match(r"(?:<{7}|>{7}|\|{7}|={7})(?:[ \n]|$)", text[pos : pos + 8]):
                    return [*out, "bad"], [*at, pos]
            t = "nl" if s in ("\n", ";", "&") else "join" if s in ("&&", "||", "|") else s if s in ("(", ")", ";;") else "redirect"
            out.append(t), at.append(start)
            command = t not in ("redirect",)
            if re.fullmatch(r"\d?>&\d?", s) and s[-1].isdigit():
                out.append("word"), at.append(start)
            continue
        m = _SH_WORD.match(text, pos)
        if not m:
            return [*out, "bad"], [*at, pos]
        w = m[0]
        t = w if (command or w in ("in", "do") or w == "}") and w in _SH_KEY else "word"
        if t in ("in", "do") and not (len(out) >= 2 and (out[-2] in ("for", "case", "select") or t == "do" and command)):
            t = "word" if not (t == "in" and len(out) >= 2 and out[-2] in ("for", "case", "select")) else t
        if t == "}" and not command:
            t = "word"
        if text.startswith("()", m.end()) and command:
            out.append("name"), at.append(pos)
            pos, command = m.end() + 2, True
            continue
        out.append(t), at.append(pos)
        pos = m.end()
        command = t in ("if", "then", "elif", "else", "while", "until", "do", "{", "!") or t == "word" and command and bool(re.fullmatch(r"\w+\+?=.*", w, re.S))
        if t in ("fi", "done", "esac", "}"):
            command = False
    # the end of a text ends its last line
    return (out, at) if out and out[-1] == "nl" else ([*out, "nl"], [*at, end])


def _shell_grammar() -> Grammar:
    """Lists of commands; compound commands nest. `list` may be empty at the top and in functions, `body` may not."""
    start = {"word": ("tail",), "redirect": ("target", "tail"), "if": ("body", "then", "body", "iftail", "tail"), "while": ("body", "do", "body", "done", "tail"), "until": ("body", "do", "body", "done", "tail"), "for": ("forname", "forin", "do", "body", "done", "tail"), "select": ("forname", "forin", "do", "body", "done", "tail"), "case": ("forname", "in", "arms", "tail"), "{": ("body", "}", "tail"), "(": ("body", ")", "tail"), "!": ("command",), "name": ("fnbody", "tail"), "function": ("forname", "fnbody", "tail")}
    lines = {"nl": ("list",)} | {k: (*v, "list") for k, v in start.items()}
    rules: dict[object, dict[str, tuple]] = {
        "list": lines, "body": {"nl": ("body",)} | {k: (*v, "list") for k, v in start.items()}, "command": dict(start), "tail": {"word": ("tail",), "redirect": ("target", "tail"), "join": ("joined",), "nl": (), "in": ("tail",), "do": ("tail",)},
        "joined": {"nl": ("joined",)} | dict(start), "target": {"word": ()}, "then": {"then": ()}, "do": {"do": (), "nl": ("do",)}, "done": {"done": ()}, "}": {"}": ()}, ")": {")": ()}, "in": {"in": (), "nl": ("in",)},
        "iftail": {"elif": ("body", "then", "body", "iftail"), "else": ("body", "fi"), "fi": ()}, "fi": {"fi": ()}, "forname": {"word": ()}, "forin": {"in": ("words",), "nl": ("forin",)}, "words": {"word": ("words",), "nl": ()},
        "arms": {"nl": ("arms",), "esac": (), "word": ("pattern", "list", "armend"), "(": ("patword", "pattern", "list", "armend")}, "patword": {"word": ()}, "pattern": {")": (), "join": ("patword", "pattern")}, "armend": {";;": ("arms",), "esac": ()}, "fnbody": {"nl": ("fnbody",), "{": ("body", "}"), "(": ("body", ")")}}
    return Grammar("list", rules, {"list", "forin"})


_YAML_KEY = re.compile(r"""(?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\[\]{},#&*!|>'"%@`:-][^\n#:]*?(?::(?! |$)[^\n#:]*?)*|-[^\s][^\n:]*?|<<)\s*:(?=\s|$)""")


_DOUBLE, _SINGLE, _CONFLICT = re.compile(r'"(?:[^"\\]|\\[\s\S])*"'), re.compile(r"'(?:[^']|'')*'"), re.compile(r"(?:<{7}|>{7}|={7})")


def lex_yaml(text: str) -> tuple[list[str], list[int]]:
    """Line tokens with in- and dedents: key (without a value), pair, item (a dash), value; `bad` where a line can't stand."""
    out: list[str] = []
    at: list[int] = []
    stack = [-1]
    joined = text.replace("\r\n", "\n")
    lines = joined.split("\n")
    pos, i = 0, 0
    base = [0]
    for x in lines:
        base.append(base[-1] + len(x) + 1)

    def bad(k: int) -> tuple[list[str], list[int]]:
        return [*out, "bad"], [*at, base[k]]

    while i < len(lines):
        line = lines[i]
        body = line.strip()
        if not body or body.startswith("#") or body in ("---", "...") or line.startswith("%"):
            i += 1
            continue
        if re.match(r"(?:<{7}|>{7}|\|{7}|={7})(?:\s|$)", line) or re.match(r" *\t", line):
            return bad(i)
        col = len(line) - len(line.lstrip(" "))
        pos = col
        while stack[-1] > col:
            stack.pop()
            out.append("<"), at.append(base[i])
        if stack[-1] < col:
            stack.append(col)
            out.append(">"), at.append(base[i])
        rest = line[pos:]
        while rest.startswith("- ") or rest == "-":
            out.append("item"), at.append(base[i] + pos)
            step = 1 + len(rest[1:]) - len(rest[1:].lstrip(" "))
            pos += step
            rest = line[pos:]
            if rest and not rest.startswith("#"):
                stack.append(pos)
                out.append(">"), at.append(base[i] + pos)
            else:
                rest = ""
        if not rest:
            i += 1
            continue
        key = _YAML_KEY.match(rest)
        value = rest[key.end() :].strip() if key else rest
        value = re.sub(r"^(?:[&!][^\s]*\s*)+", "", value)
        if value.startswith("#"):
            value = ""
        if re.match(r"[|>][+-]?\d?[+-]?\s*(?:#.*)?$", value):
            own, i = stack[-1], i + 1
            while i < len(lines) and (not lines[i].strip() or len(lines[i]) - len(lines[i].lstrip(" ")) > own):
                i += 1
            out.append("pair" if key else "value"), at.append(base[i - 1])
            continue
        if value[:1] in ('"', "'"):
            # the closing quote, in one search from the opening one to the end of the text
            start = base[i] + line.index(value[:1], pos + (key.end() if key else 0))
            whole = (_DOUBLE if value[0] == '"' else _SINGLE).match(joined, start)
            if not whole:
                return bad(i)
            k = bisect_right(base, whole.end() - 1) - 1
            rest_of = joined[whole.end() : base[k + 1] - 1]
            if not re.fullmatch(r"\s*(?:#.*)?", rest_of) or any(_CONFLICT.match(x) for x in lines[i + 1 : k + 1]):
                return bad(i)
            i = k
        elif value[:1] in ("[", "{"):
            k, parts = i, [value]
            open_ = _depth(value)
            # the whole is read again only where the brackets of its lines are even
            while open_ > 0 or not _balanced("\n".join(parts)):
                k += 1
                if k >= len(lines) or _CONFLICT.match(lines[k]):
                    return bad(i)
                parts.append(lines[k])
                open_ += _depth(lines[k])
            i = k
        elif value[:1] in ("@", "`", "%", "]", "}", ",") or re.match(r"[^\"'#]*: ", value) and key or value.endswith(":") and key:
            return bad(i)
        elif value and not key:
            # a plain scalar may go on in deeper lines
            pass
        if key and value:
            own = stack[-1]
            while i + 1 < len(lines) and lines[i + 1].strip() and len(lines[i + 1]) - len(lines[i + 1].lstrip(" ")) > own and not lines[i + 1].strip().startswith(("#", "- ")) and not _YAML_KEY.match(lines[i + 1].strip()) and value[:1] not in "\"'[{":
                i += 1
        out.append("pair" if key and value else "key" if key else "value"), at.append(base[i])
        i += 1
    while stack[-1] > -1:
        stack.pop()
        out.append("<"), at.append(base[-1])
    return out, at


def _depth(line: str) -> int:
    """Brackets opened less those closed, without the quoted ones of the line."""
    t = re.sub(r'"(?:[^"\\]|\\.)*"|\'(?:[^\']|\'\')*\'|\s#.*', "s", line)
    return t.count("[") + t.count("{") - t.count("]") - t.count("}")


def _balanced(flow: str) -> bool:
    t = re.sub(r'"(?:[^"\\]|\\[\s\S])*"|\'(?:[^\']|\'\')*\'', "s", flow)
    t = re.sub(r"\s#[^\n]*", "", t)
    return t.count("[") == t.count("]") and t.count("{") == t.count("}") and '"' not in t


def _yaml_grammar() -> Grammar:
    """A node is a mapping, a sequence or a scalar; what stands at one depth is of one kind."""
    rules = {"doc": {">": ("node",)}, "node": {"key": ("sub", "map"), "pair": ("map",), "item": ("in", "seq"), "value": ("text",)}, "map": {"key": ("sub", "map"), "pair": ("map",), "<": ()}, "sub": {">": ("node",), "item": ("in", "flat")}, "flat": {"item": ("in", "flat")}, "in": {">": ("node",)}, "seq": {"item": ("in", "seq"), "<": ()}, "text": {"value": ("text",), "<": ()}}
    return Grammar("doc", rules, {"doc", "sub", "in", "flat"})


_PY = re.compile(r"""(?P<skip>[ \t\f]+|\\\r?\n|\#[^\n]*|\r)|(?P<nl>\n)|(?P<str>(?:[rRbBuUfFtT]{0,3})(?:\"{3}(?:[^\\]|\\[\s\S])*?\"{3}|'{3}(?:[^\\]|\\[\s\S])*?'{3}|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'))|(?P<num>0[xXoObB][0-9a-fA-F_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[jJ]?(?!\w))|(?P<word>[^\W\d]\w*)|(?P<op>\*\*=?|//=?|>>=?|<<=?|!=|->|:=|\.\.\.|[-+*/%@&|^=<>]=|[-+*/%@&|^~<>()\[\]{},:.;=])|(?P<bad>[\s\S])""")
_PY_BLOCK = frozenset("def class if elif else for while try except finally with async match case".split())
_PY_UNARY = frozenset("not lambda await yield return del raise assert import from global nonlocal print exec".split()) - {"print", "exec"}
_PY_BINARY = frozenset("and or in is as".split())


def lex_python(text: str) -> tuple[list[str], list[int]]:
    out: list[str] = []
    at: list[int] = []
    stack, depth, line_start, pos = [0], 0, True, 0
    text = text.removeprefix("\ufeff").expandtabs(8) if "\t" in text and "\n\t" in text else text.removeprefix("\ufeff")
    while pos < len(text):
        if line_start and not depth:
            m = re.compile(r"[ \t\f]*").match(text, pos)
            col, nxt = len(m[0]), text[m.end() : m.end() + 1]
            if nxt and nxt not in "\r\n#":
                if col > stack[-1]:
                    stack.append(col)
                    out.append(">"), at.append(pos)
                while col < stack[-1]:
                    stack.pop()
                    out.append("<"), at.append(pos)
                if col != stack[-1]:
                    return [*out, "bad"], [*at, pos]
            line_start = False
        m = _PY.match(text, pos)
        k, start, pos = m.lastgroup, pos, m.end()
        if k == "skip":
            continue
        if k == "nl":
            if not depth:
                if out and out[-1] not in ("nl", ">", "<"):
                    out.append("nl"), at.append(start)
                line_start = True
            continue
        s = m[0]
        if k == "op":
            t = s if s in "()[]{},:.;" else "=" if s == "=" or s.endswith("=") and s not in ("==", "!=", "<=", ">=") else "sign" if s in "+-*~**" else "op"
            depth += (s in "([{") - (s in ")]}")
        elif k == "word":
            first = not out or out[-1] in ("nl", ">", "<", ";")
            t = "block" if s in _PY_BLOCK and first and not (s in ("match", "case") and re.match(r"\s*[=.,(\[)]", text[pos : pos + 3])) else "un" if s in _PY_UNARY else "bin" if s in _PY_BINARY else "tern" if s in ("if", "else", "for", "async") else "id"
        else:
            t = k
        out.append(t), at.append(start)
    if out and out[-1] != "nl":
        out.append("nl"), at.append(pos)
    out += ["<"] * (len(stack) - 1)
    at += [pos] * (len(stack) - 1)
    return out, at


def _python_grammar() -> Grammar:
    """Statements by line; `h` lines (block keywords) end in a colon and a suite. Within a line, classes follow by table."""
    vals = {"id", "num", "str"}
    starts = vals | {"un", "sign", "(", "[", "{", "block"}
    after = {"op", "sign", "bin", "tern", "=", ",", ".", "(", "[", ":", "un"}
    follow = {"id": after, "num": after - {"("}, "str": after | {"str"}, ")": after, "]": after, "}": after, "op": starts | {":"} - {":"}, "sign": starts | {",", ":"} - {":"}, "bin": starts, "tern": starts | {":", "tern"}, "=": starts, ",": starts | {"op", "tern", "="} - {"op", "="}, ".": {"id", "un", "tern", "bin", ".", "block"}, ":": starts | {"=", ",", ":"}, "un": starts | {".", "bin", ":", ",", "op", "="} - {"op", "="}, "block": starts | {":", "tern", ".", "="}, "^": starts | {".", "op", ":", "tern"}}
    ends = {"id", "num", "str", ")", "]", "}", ",", "un", ".", "tern", "sign"}
    rules: dict[object, dict[str, tuple]] = {}
    empty: set = set()
    inner = {"(": "P", "[": "K", "{": "D"}
    close = {"P": ")", "K": "]", "D": "}"}
    for ctx in ("S", "H", "P", "K", "D"):
        for last in [*follow]:
            out: dict[str, tuple] = {}
            for t in follow[last]:
                if t in inner:
                    out[t] = ((inner[t], "^"), (ctx, _OPENERS[t]))
                else:
                    out[t] = ((ctx, t),)
            if ctx in close:
                if last in ends | {"^", ":", "sign"}:
                    out[close[ctx]] = ()
            elif ctx == "S":
                if last in ends | {":"} - {":"} or last == "^":
                    out["nl"] = ()
                    out[";"] = (("S", "^"),)
            else:
                if last == ":":
                    out = {"nl": ("suite",)} | {t: v for t, v in out.items()}
                if last in ends:
                    out |= {"nl": ("oneline",), ";": (("S", "^"),)}
            rules[(ctx, last)] = out
    first = {t: v for t, v in rules[("S", "^")].items() if t not in ("nl", ";", "block")}
    line = first | {"block": (("H", "block"),), "op": (("H", "op"),)}
    rules["file"] = {t: (*v, "file") for t, v in line.items()} | {"nl": ("file",)}
    rules["suite"] = {">": ("lines1",)}
    rules["lines1"] = {t: (*v, "lines") for t, v in line.items()}
    rules["lines"] = {t: (*v, "lines") for t, v in line.items()} | {"<": ()}
    rules["oneline"] = {}
    empty |= {"file", "oneline"}
    return Grammar("file", rules, empty)


_GRAMMARS: dict[str, Grammar] = {}


def grammar(lang: str) -> Grammar:
    if lang not in _GRAMMARS:
        _GRAMMARS[lang] = {"json": _json_grammar, "yaml": _yaml_grammar, "shell": _shell_grammar, "python": _python_grammar}.get(lang, lambda: _tables(lang))()
    return _GRAMMARS[lang]


_LEXERS = {"json": lex_json, "yaml": lex_yaml, "shell": lex_shell, "python": lex_python}


def verdict(text: str | None, language: str | None, path: str | None) -> tuple[str | None, int]:
    """(fault, place): None for a valid text or one that isn't judged; `token` with its offset, `truncated`, or `parser`."""
    if not text or not text.strip():
        return None, -1
    lang = language_of(language, path)
    if lang is None:
        return None, -1
    toks, at = _LEXERS[lang](text) if lang in _LEXERS else lex(text, lang)
    i = grammar(lang).check(toks)
    if i is not None:
        return ("truncated", len(text)) if i >= len(toks) else ("token", at[i])
    # an exact check of what the grammar accepts
    try:
        if lang == "python":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                compile(text, "x", "exec", flags=ast.PyCF_ONLY_AST, dont_inherit=True)
        elif lang == "json":
            json.loads(text)
    except (SyntaxError, ValueError):
        return "parser", -1
    except (RecursionError, MemoryError):
        return None, -1
    return None, -1


def judge(df: DataFrame, key: str = "id", text: str = "text", language: str = "language", path: str = "file_path") -> DataFrame:
    """(key, lang, fault, place) of each row; lang is the language it was read in, null if it wasn't judged."""
    require(df, key, text, language, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, paths = b.column(2).to_pylist(), b.column(3).to_pylist()
            got = [verdict(t, la, p) for t, la, p in zip(b.column(1).to_pylist(), langs, paths)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([language_of(la, p) for la, p in zip(langs, paths)], pa.string()), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64())], names=[key, "lang", "fault", "place"])

    kind = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("lang", T.StringType()), T.StructField("fault", T.StringType()), T.StructField("place", T.LongType())])
    return spread(df.select(key, text, language, path)).mapInArrow(run, kind)


def found_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "code_input")).filter("fault IS NOT NULL").select("id").distinct()


def rates_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and faulty files by repository and language; files delivered twice count once."""
    src = table(spark, sf_dir, "code_input")
    repo = F.coalesce("repo_name", F.nullif(F.regexp_extract(F.coalesce("file_path", F.lit("")), r"repos/([^/]+/[^/]+)/", 1), F.lit("")))
    one = judge(src).groupBy("id").agg(F.max("lang").alias("lang"), F.max(F.col("fault").isNotNull()).alias("bad"))
    repos = src.groupBy("id").agg(F.min(repo).alias("repo"))
    return one.join(repos, "id").filter("lang IS NOT NULL").groupBy("repo", "lang").agg(F.count("*").alias("n_files"), F.sum(F.col("bad").cast("int")).alias("n_faulty")).withColumn("rate", F.col("n_faulty") / F.col("n_files"))
