"""Parsing with derivatives, memoised.

The language still to be read is a set of sequences of grammar symbols, kept by their first symbols: each symbol once, with
the language of all that may follow it. Ways to read a bracket so share what stands around it, and n brackets inside each
other take n languages whatever the number of their readings. The derivative by a token is the set of what remains after
each way to read that token; derivatives are kept by (language, token), so that files of one language share them and most
tokens cost a look-up. An empty derivative marks the token that no program continues with; a language at the end that
holds no empty sequence marks a cut-off text.
"""

from __future__ import annotations

import re
import sys
from functools import cache

from corpusmill.llm.grammars import LANGUAGES

#: Languages kept before the memory is begun anew.
MOST_LANGUAGES = 100_000
#: Keys of a language beside its tokens.
HEADS, END, NUMBER = 0, 1, 2

# rules that may be empty are looked through one inside the other, as deep as a text has them
sys.setrecursionlimit(max(sys.getrecursionlimit(), 200_000))


class Grammar:
    """Rules with sequences of symbols; a symbol is a terminal's text or a rule's number."""

    def __init__(self, text: str):
        self.names: dict[str, int] = {}
        self.rules: list[list[tuple]] = []
        joined = re.sub(r"\n[ \t]+", " ", text)
        for line in joined.split("\n"):
            if "=" in line:
                name, _, right = line.partition("=")
                self._items = re.findall(r"'[^']*'|\w+|[()|?*+]", right)
                self._at = 0
                n = self._number(name.strip())
                self.rules[n] += self._alternatives()
        missing = [n for n, i in self.names.items() if not self.rules[i]]
        assert not missing, missing
        self.nullable = [False] * len(self.rules)
        changed = True
        while changed:
            changed = False
            for i, alternatives in enumerate(self.rules):
                if not self.nullable[i] and any(all(isinstance(s, int) and self.nullable[s] for s in a) for a in alternatives):
                    self.nullable[i] = changed = True
        self._first: dict[tuple, frozenset] = {}

    def _number(self, name: str) -> int:
        if name not in self.names:
            self.names[name] = len(self.rules)
            self.rules.append([])
        return self.names[name]

    def _new(self, alternatives: list[tuple]) -> int:
        self.rules.append(alternatives)
        return len(self.rules) - 1

    def _alternatives(self) -> list[tuple]:
        out, sequence = [], []
        while self._at < len(self._items):
            item = self._items[self._at]
            if item == ")":
                break
            self._at += 1
            if item == "|":
                out.append(tuple(sequence))
                sequence = []
                continue
            if item == "(":
                inner = self._alternatives()
                self._at += 1
                symbol = self._new(inner)
            elif item[0] == "'":
                symbol = item[1:-1]
            else:
                symbol = item if item.isupper() or item == "OP2" else self._number(item)
            while self._at < len(self._items) and self._items[self._at] in "?*+":
                mark = self._items[self._at]
                self._at += 1
                if mark == "?":
                    symbol = self._new([(symbol,), ()])
                else:
                    loop = self._new([])
                    self.rules[loop] += [(symbol, loop), ()]
                    symbol = loop if mark == "*" else self._new([(symbol, loop)])
            sequence.append(symbol)
        out.append(tuple(sequence))
        return out

    def after(self, rule: int, token: str) -> frozenset:
        """What may remain of `rule` once `token` is read."""
        key = (rule, token)
        known = self._first.get(key)
        if known is None:
            self._first[key] = frozenset()  # a rule that begins with itself adds nothing
            out = set()
            for sequence in self.rules[rule]:
                for i, s in enumerate(sequence):
                    if isinstance(s, str):
                        if s == token or s == "ANY" and token not in ("(", ")", "[", "]", "{", "}", "ERR", "END"):
                            out.add(sequence[i + 1 :])
                        break
                    for rest in self.after(s, token):
                        out.add(rest + sequence[i + 1 :])
                    if not self.nullable[s]:
                        break
            known = self._first[key] = frozenset(out)
        return known


class Parser:
    def __init__(self, spec: dict):
        self.grammar = Grammar(spec["grammar"])
        self.words = set(spec["words"].split())
        self.style = spec.get("style", "")
        kinds = spec["token"]
        newline = "|(?P<NL>\\n)" if self.style else ""
        self.scan = re.compile(
            f"(?P<SKIP>{spec['skip']})" + newline + "|" + "|".join(f"(?P<{k}>{_numbered(p, k)})" for k, p in kinds) + r"|(?P<ERR>[\s\S])"
        )
        # the same tokens without kinds, for texts where a token's text tells its kind
        # (raw strings with a chosen end are left out: texts that may hold one are read the other way)
        pattern = "|".join(re.sub(r"\(\?P<\w+>", "(?:", p) for k, p in kinds if "\\1" not in p)
        line = {"js": _TEMPLATE + "\\n|", "go": "\\n|", "python": r"\n[ \t]*|"}.get(self.style, "")
        self.quick = re.compile(f"(?:{spec['skip']})*+({line}{pattern}|[\\s\\S]|\\Z)")
        self.classes: dict[str, str] = {}
        self.numbered = 0
        self._begin()

    def _kind(self, word: str) -> str:
        """The class of a token's text, kept."""
        m = self.scan.match(word)
        kind = m.lastgroup
        t = "TEMPLATE" if word[0] == "`" and self.style == "js" and len(word) > 1 else "ERR" if m.end() < len(word) or kind == "ERR" else self._class(kind, word)
        if len(self.classes) > 300_000:
            self.classes.clear()
        self.classes[word] = t
        return t

    def _begin(self) -> None:
        self.known: dict[tuple, dict] = {}
        self.merged: dict[frozenset, dict] = {}
        self.empty, self.nothing = self._language(True, {}), self._language(False, {})
        self.start = self._language(False, {self.grammar.names["start"]: self.empty})

    def _language(self, end: bool, heads: dict) -> dict:
        """The language of `end` (the empty sequence) and of each head symbol with its rests, kept once. A language is a
        dictionary of its derivatives by token; HEADS, END and NUMBER hold what it is made of."""
        key = (end, *sorted((str(s), rest[NUMBER]) for s, rest in heads.items()))
        d = self.known.get(key)
        if d is None:
            d = self.known[key] = {HEADS: heads, END: end, NUMBER: self.numbered}
            self.numbered += 1
        return d

    def _union(self, languages: list[dict]) -> dict:
        """Sequences that begin with the same symbol share it; their rests are united, so that alternatives within one
        bracket stay one tail for all brackets inside it."""
        if len(languages) == 1:
            return languages[0]
        numbers = frozenset(x[NUMBER] for x in languages)
        out = self.merged.get(numbers)
        if out is None:
            rests: dict = {}
            for x in {x[NUMBER]: x for x in languages}.values():
                for s, rest in x[HEADS].items():
                    rests.setdefault(s, []).append(rest)
            heads = {s: self._union(r) for s, r in rests.items()}
            out = self.merged[numbers] = self._language(any(x[END] for x in languages), heads)
        return out

    def _push(self, symbols: tuple, rest: dict) -> dict:
        for s in reversed(symbols):
            rest = self._language(False, {s: rest})
        return rest

    def derive(self, language: dict, token: str) -> dict:
        """The derivative of a language by a token, from memory if it was asked for before."""
        known = language.get(token)
        if known is not None:
            return known
        out, nullable = [], self.grammar.nullable
        for symbol, rest in language[HEADS].items():
            if isinstance(symbol, str):
                if symbol == token:
                    out.append(rest)
                continue
            out += [self._push(remains, rest) for remains in self.grammar.after(symbol, token)]
            if nullable[symbol]:
                out.append(self.derive(rest, token))
        d = language[token] = self._union(out) if out else self.nothing
        return d

    def complete(self, language: dict) -> bool:
        """Whether the language holds the empty sequence."""
        seen, todo = set(), [language]
        while todo:
            x = todo.pop()
            if x[END]:
                return True
            for s, rest in x[HEADS].items():
                if not isinstance(s, str) and self.grammar.nullable[s] and rest[NUMBER] not in seen:
                    seen.add(rest[NUMBER])
                    todo.append(rest)
        return False

    def _renew(self, language: dict) -> dict:
        """Begin the memory anew, within a text as between texts; only what the text may go on with is kept."""
        self._begin()
        copies: dict[int, dict] = {}
        todo = [language]
        while todo:
            x = todo[-1]
            missing = [r for r in x[HEADS].values() if r[NUMBER] not in copies]
            if missing:
                todo += missing
                continue
            todo.pop()
            copies[x[NUMBER]] = self._language(x[END], {s: copies[r[NUMBER]] for s, r in x[HEADS].items()})
        return copies[language[NUMBER]]

    def parse(self, text: str) -> tuple[str, int] | None:
        """None for a valid text; else ("token" or "end", line of the failing token)."""
        language = self.start
        if not _RAW.search(text) and (words := self._words(text)) is not None:
            for token in words:
                following = language.get(token)
                if following is None:
                    if len(self.known) > MOST_LANGUAGES:
                        language = self._renew(language)
                    following = self.derive(language, token)
                language = following
                if language is self.nothing:
                    break
            else:
                if self.complete(language):
                    return None
            language = self.start  # once more with places
        for token, at in self.tokens(text):
            following = language.get(token)
            if following is None:
                if len(self.known) > MOST_LANGUAGES:
                    language = self._renew(language)
                following = self.derive(language, token)
            language = following
            if language is self.nothing:
                return "token", text.count("\n", 0, at) + 1
        return None if self.complete(language) else ("end", text.count("\n") + 1)

    def _words(self, text: str):
        """The classes of all tokens, or None where a token's kind depends on what stands before it."""
        if self.style == "python":
            return self._lines(text)
        classes, words = self.classes, self.quick.findall(text)
        while words and not words[-1]:
            words.pop()
        kinds = [classes.get(w) or self._kind(w) for w in words] if not self.style else [w if w == "\n" else classes.get(w) or self._kind(w) for w in words]
        if not self.style:
            return [k for k in kinds if k != "SKIP"]
        out: list[str] = []
        last = ""
        if self.style == "go":
            for t in kinds:
                if t == "\n":
                    if last in _GO_ENDS:
                        last = ";"
                        out.append(";")
                elif t != "SKIP":
                    last = t
                    out.append(t)
            if last in _GO_ENDS:
                out.append(";")
            return out
        if "/" in kinds or "/=" in words:
            return None
        depth: list[str] = []
        line_end = False
        for t in kinds:
            if t == "\n":
                line_end = True
                continue
            if t == "SKIP":
                return None
            if line_end:
                line_end = False
                if last in _JS_ENDS and (t in _JS_BEGINS or (t == "{" and last not in (")", "=>"))) and (not depth or depth[-1] == "{"):
                    out.append(";")
            if t in "([{":
                depth.append(t)
            elif t in ")]}" and depth:
                depth.pop()
            last = t
            out.append(t)
        return out

    def _lines(self, text: str) -> list[str]:
        """The classes of a Python text's tokens, with NL, INDENT and DEDENT."""
        if "\t" in text and _TABS.search(text):
            return [t for t, _ in self._python(text)]
        out: list[str] = []
        classes, depth, indents, last, begin = self.classes, 0, [0], "NL", 0
        text = text.replace("\r\n", "\n").lstrip("\ufeff")
        begin = len(text) - len(text.lstrip(" \t")) if text[:1] in (" ", "\t") else 0
        for w in self.quick.findall(text):
            if not w:
                continue
            if w[0] == "\n":
                if depth == 0:
                    begin = len(w) - 1 if "\t" not in w else len(w[1:].expandtabs(8))
                    if last != "NL":
                        last = "NL"
                        out.append("NL")
                continue
            if w.isspace() or w == "\\\n":
                continue
            if last == "NL" and depth == 0:
                if begin != indents[-1]:
                    if begin > indents[-1]:
                        indents.append(begin)
                        out.append("INDENT")
                    else:
                        while begin < indents[-1]:
                            indents.pop()
                            out.append("DEDENT")
                        if begin != indents[-1]:
                            out.append("ERR")
            last = t = classes.get(w) or self._kind(w)
            if t == "SKIP":
                last = "NL" if not out else out[-1]
                continue
            if t in "([{":
                depth += 1
            elif t in ")]}":
                depth -= 1
            out.append(t)
        if last != "NL":
            out.append("NL")
        out += ["DEDENT"] * (len(indents) - 1)
        return out

    def tokens(self, text: str):
        if self.style == "js":
            yield from self._js(text)
        elif self.style == "go":
            yield from self._go(text)
        elif self.style == "python":
            yield from self._python(text)
        else:
            for kind, word, at in self._plain(text):
                yield self._class(kind, word), at

    def _class(self, kind: str, word: str) -> str:
        if kind == "OP" or (kind == "NAME" and word in self.words):
            return word
        return "STR" if kind == "RAW" else kind

    def _plain(self, text: str):
        for m in self.scan.finditer(text):
            kind = m.lastgroup
            if kind != "SKIP":
                yield kind, m.group(), m.start()

    def _go(self, text: str):
        """A line end after a token that may end a statement is a semicolon."""
        last = ""
        for kind, word, at in self._plain(text):
            if kind == "NL":
                if last in _GO_ENDS:
                    last = ";"
                    yield ";", at
                continue
            last = self._class(kind, word)
            yield last, at
        if last in _GO_ENDS:
            yield ";", len(text)

    def _js(self, text: str):
        """Regular expressions and templates are found by what stands before them; a line end between a token that may
        end a statement and one that may begin one is a semicolon."""
        last, line_end, at, n = "", False, 0, len(text)
        depth: list[str] = []
        while at < n:
            c = text[at]
            if c == "`":
                end = _template(text, at)
                if end < 0:
                    yield "ERR", at
                    return
                kind, word, start, at = "TEMPLATE", "", at, end
            elif c == "/" and text[at + 1 : at + 2] not in ("/", "*") and last not in _JS_ENDS and (m := _REGEX.match(text, at)):
                kind, word, start, at = "REGEX", "", at, m.end()
            elif c == "/" and text[at + 1 : at + 2] == "=" and last in _JS_ENDS:
                kind, word, start, at = "OP2", "/=", at, at + 2
            else:
                m = self.scan.match(text, at)
                kind, word, start = m.lastgroup, m.group(), at
                at = m.end()
                if kind == "SKIP":
                    line_end = line_end or "\n" in word
                    continue
                if kind == "NL":
                    line_end = True
                    continue
            token = self._class(kind, word)
            if line_end:
                line_end = False
                if last in _JS_ENDS and (token in _JS_BEGINS or (token == "{" and last not in (")", "=>"))) and (not depth or depth[-1] == "{"):
                    yield ";", start
            if token in ("(", "[", "{"):
                depth.append(token)
            elif token in (")", "]", "}") and depth:
                depth.pop()
            last = token
            yield token, start

    def _python(self, text: str):
        """Logical lines with INDENT and DEDENT; line ends inside brackets do not count."""
        depth, indents, others, fresh, last = 0, [0], [0], True, "NL"
        text = text.replace("\r\n", "\n").lstrip("﻿")
        for m in self.scan.finditer(text):
            kind = m.lastgroup
            if kind == "SKIP":
                continue
            at = m.start()
            if kind == "NL":
                if depth == 0 and last != "NL":
                    last = "NL"
                    fresh = True
                    yield "NL", at
                continue
            if fresh:
                fresh = False
                column = other = 0  # with tabs to the next multiple of 8, and with tabs as single columns: both must agree
                for c in text[text.rfind("\n", 0, at) + 1 : at]:
                    column = column + 1 if c == " " else (column // 8 + 1) * 8 if c == "\t" else 0
                    other = other + 1 if c in " \t" else 0
                if column > indents[-1]:
                    indents.append(column)
                    if other <= others[-1]:
                        yield "ERR", at
                        return
                    others.append(other)
                    yield "INDENT", at
                else:
                    while column < indents[-1]:
                        indents.pop()
                        others.pop()
                        yield "DEDENT", at
                    if column != indents[-1] or other != others[-1]:
                        yield "ERR", at
                        return
            word = m.group()
            last = self._class(kind, word)
            if kind == "OP":
                if word in "([{":
                    depth += 1
                elif word in ")]}":
                    depth -= 1
            yield last, at
        if last != "NL":
            yield "NL", len(text)
        for _ in indents[1:]:
            yield "DEDENT", len(text)


_GO_ENDS = {"NAME", "NUM", "STR", "CHR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}
_JS_ENDS = {"NAME", "NUM", "STR", "TEMPLATE", "REGEX", "PRIVATE", ")", "]", "}", "++", "--", "this", "super", "null", "true", "false", "return", "break", "continue", "debugger",
            "of", "get", "set", "async", "as", "from", "static", "type", "void", "declare", "namespace", "is", "private", "public", "protected", ">"}
_JS_BEGINS = {"NAME", "NUM", "STR", "PRIVATE", "@", "...", "!", "~", "++", "--", "this", "super", "null", "true", "false", "var", "let", "const", "return", "throw", "break", "continue", "debugger",
              "if", "while", "with", "for", "do", "try", "switch", "case", "default", "async", "function", "class", "import", "export", "new", "typeof", "void", "delete", "await", "yield", "static", "get", "set",
              "type", "declare", "abstract", "readonly", "namespace", "private", "public", "protected", "override", "interface", "enum", "of", "from"}
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/\w*")


def _template(text: str, at: int) -> int:
    """The end of the template literal that begins at `at`, or -1; ${...} may hold templates and strings again."""
    at += 1
    n = len(text)
    while at < n:
        c = text[at]
        if c == "\\":
            at += 2
        elif c == "`":
            return at + 1
        elif c == "$" and text[at + 1 : at + 2] == "{":
            depth, at = 1, at + 2
            while at < n and depth:
                c = text[at]
                if c == "{":
                    depth += 1
                elif c == "}":
                    depth -= 1
                elif c == "`":
                    at = _template(text, at)
                    if at < 0:
                        return -1
                    continue
                elif c in "'\"" and (m := _QUOTED.match(text, at)):
                    at = m.end()
                    continue
                at += 1
        else:
            at += 1
    return -1


_TABS = re.compile(r"(?m)^ *\t")
_RAW = re.compile(r'R"[^()\\\s"]{0,16}\(|\br#+"')
_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{[^{}`'\"]*\})*`|"
_QUOTED = re.compile(r"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"")


def _numbered(pattern: str, kind: str) -> str:
    """A back-reference in a token's pattern by name, as the pattern stands among others."""
    if "\\1" not in pattern:
        return pattern
    out = re.sub(r"\((?!\?)", f"(?P<{kind}q>", pattern, count=1)
    return out.replace("\\1", f"(?P={kind}q)")


@cache
def parser(extension: str) -> Parser:
    return Parser(LANGUAGES[extension])
