"""Secret scans: base patterns, and an assignment-aware lexer for source and configuration text.

The lexer reads name-literal pairs in the syntaxes of common languages and formats:

- ``name = "x"``, ``name: type = "x"``, ``var name string = "x"``, ``name := `x```, ``{"name": "x"}``, ``:name => 'x'``
- ``conf["name"] = "x"``, ``define('NAME', 'x')``, ``<name>x</name>``, ``<add key="name" value="x"/>``
- ``type *name = "x"``, ``type name("x")``, ``#define NAME "x"``, ``obj.setName("x")``, ``a, name = "x", "y"``
- ``export NAME=x``, ``name: x``, ``name: |`` with a block below, ``--name=x``, ``--name x``, and names inside another's value

A value is an expression: strings with escapes, triple quotes, back-quotes and prefixes, on the same line or the next;
concatenations; joined lists; templates; alternatives and conditions; calls with literal arguments, however deep; names of
constants. Constants are followed wherever they are defined and through any number of others. A name that isn't defined
in the text, a subscript, and what a lookup (``getenv("X")``) is given are no literals. Each literal is scored by how sensitive
the target's name is and how much it looks like a key; a name is read by its parts, so ``author`` is not ``auth``, and one
that says that the value is something about a secret (``token_url``) is not sensitive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, rows_of, utf8

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of fewer than 32 is dropped by the contract, so asking for 32 finds the same runs.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_HEX_BYTES = re.compile(rb"[0-9a-f]{32}")

#: Definitions that are looked up for the names of one text, each name for itself, before those of the other names are gone
#: through together, with the same results: a text may define a constant by its last value thousands of times.
VISITS = 200_000
#: Parts of names that say how sensitive the target is.
SENSITIVE = {"password": 3, "passwd": 3, "passphrase": 3, "pwd": 2, "secret": 3, "token": 2, "apikey": 3, "privatekey": 3, "accesskey": 3, "credential": 2, "auth": 1, "bearer": 2, "signingkey": 3, "encryptionkey": 3, "secretkey": 3, "salt": 1}
#: Those that stand for themselves within a longer word, as in ``dbpassword``.
_WITHIN = re.compile(r"password|passwd|passphrase|secret(?!ar|ion|ive)|apikey|privatekey|accesskey|signingkey|encryptionkey|credential")
#: Last parts of names of what is about a secret and none itself.
_ABOUT = frozenset("url uri name names header headers endpoint type field path file filename count length size ttl expiry expires timeout help prompt label hint regex pattern prefix format class version algorithm policy column param parameter placeholder description error message title".split())
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Names may hold these characters between the letters that count.
_BETWEEN = b"_.-0123456789"
_SENSITIVE_BYTES = re.compile(rb"pass(?:word|wd|phrase)|pwd|secret|token|key|credential|auth|bearer|salt")
_ASSIGNS = re.compile(rb"[=:<({]|--|#[ \t]*define")
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|none|null|true|false|changeme|example|placeholder|your[_-].*|<.*>|\$\{.*\}|%\(.*\)s)$")
_NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*+"
#: ``str``, ``Optional[str]``, ``str | None``, ``&'static str``, ``string?``
_TYPE = r"""(?:[&*]|'[a-z_]+\x20)*[A-Za-z_](?:[A-Za-z0-9_.]|::)*+(?:\[[^\]\n="':]*\]+|<(?:[^>\n="':]|::)*>+|\?)*(?:\x20*\|\x20*[A-Za-z_][A-Za-z0-9_.]*)*"""
#: Types of Go; in ``const char *name`` the second word is no name.
_GO = r"(?:\[[0-9.]*\]|\*)*(?:string|byte|rune|error|any|bool|u?int[0-9]*|float[0-9]+|[a-z][a-z0-9_]*\.[A-Z][A-Za-z0-9_]*|[A-Z][A-Za-z0-9_]*)"
#: A name up to where its value begins. The value isn't part of the match, so names inside of it are read too.
_HEAD = re.compile(
    rf"""(?<![A-Za-z0-9_.\-])(?:(?:var|const|let|val)\x20+(?P<go>{_NAME})\x20+{_GO}\x20*=(?![=>])"""
    rf"""|[.\-]*+(?P<quote>\\?["'`]|)(?P<name>{_NAME})(?P=quote)(?:\[[0-9]*\]|\]|[?!])?"""
    rf"""(?:[\x20\t]*:[\x20\t]*(?P<type>{_TYPE})[\x20\t]*=(?![=>])|[\x20\t]*(?P<sep>=>|:=|={{1,3}}|:(?!:))))[\x20\t]*""",
    re.ASCII,
)
_SETTER = re.compile(rf"""\b(?:define|setenv|putenv|set|put|setProperty|setdefault|add_header|header)\(\x20*(["'])(?P<name>{_NAME})\1\x20*,\x20*""", re.ASCII)
#: ``type name("x")`` and ``type name{"x"}``; a statement's word is no type.
_DECLARED = re.compile(rf"""(?<![A-Za-z0-9_.\-])(?!(?:return|new|def|fn|func|function|throw|raise|await|yield|in|is|not|and|or|if|elif|while|else|case|print|echo|import|from|del|assert|with|class|struct)\b)[A-Za-z_](?:[A-Za-z0-9_]|::)*+(?:<[^<>\n]*>)?[\x20\t]*[&*\x20\t][\x20\t]*(?P<name>{_NAME})[\x20\t]*[({{][\x20\t]*(?=["'])""", re.ASCII)
_DEFINE = re.compile(rf"""#[\x20\t]*define[\x20\t]+(?P<name>{_NAME})[\x20\t]+""", re.ASCII)
_SETS = re.compile(r"""(?<![A-Za-z0-9_])(?:set|with|add|use)_?(?P<name>[A-Za-z][A-Za-z0-9_]*)\([\x20\t]*(?=[rbfu]?["'`])""", re.ASCII)
_FLAG = re.compile(rf"""(?<!\S)--?(?P<name>[A-Za-z][A-Za-z0-9_.\-]*+)[\x20\t]+(?=[^\s\-])""", re.ASCII)
_LIST = re.compile(rf"""(?<![A-Za-z0-9_.\-$]){_NAME}(?:[\x20\t]*,[\x20\t]*{_NAME})++""", re.ASCII)
_EQUALS, _COMMA = re.compile(r"[\x20\t]*:?=(?![=>])[\x20\t]*[(\[]?[\x20\t]*"), re.compile(r"[\x20\t]*,[\x20\t]*")
_BLOCK = re.compile(r"[|>][+\-0-9]*[\x20\t]*\r?\n")
_LINE = re.compile(r"([\x20\t]*)([^\r\n]*)(?:\r?\n|\Z)")
_ELEMENT = re.compile(rf"""<(?P<tag>[A-Za-z_][A-Za-z0-9_.\-]*+)(?P<attributes>[^<>]*+)>\s*(?:<!\[CDATA\[\s*(?P<data>[^\]]*?)\s*\]\]>|(?P<body>[^<>\s][^<>]*?))\s*</(?P=tag)\s*>""", re.ASCII)
_KEYED = re.compile(rf"""\b(?:key|name|id)\x20*=\x20*(["'])(?P<name>{_NAME})\1""", re.ASCII)
_VALUED = re.compile(r"""\x20+(?:value|content)\x20*=\x20*""")
_STRING = re.compile(
    r"""(?:[rbfuRBFU]{1,2}|[@$])?(?:\"{3}((?:[^"\\]|\\.|"(?!""))*+)\"{3}|'{3}((?:[^'\\]|\\.|'(?!''))*+)'{3}|"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`([^`]*+)`"""
    r"""|\\"((?:(?!\\?")[^\n])*+)\\"|\\'((?:(?!\\?')[^\n])*+)\\')""",
    re.DOTALL,
)
_CALL = re.compile(r"""(?:new\x20+|await\x20+|\$)?(?P<callee>[A-Za-z_](?:[A-Za-z0-9_.]|::|->)*+)!?(?P<open>[(\[])[\x20\t]*""", re.ASCII)
#: Functions whose first argument is the name of what they look up.
_LOOKUP = re.compile(r"(?i)(?:env|get|lookup|read|open|load|fetch|find|config|input|query|param|prompt)[a-z_]*$")
_BARE = re.compile(r"[A-Za-z0-9+/_.~\-]+=*")
_VARIABLE = re.compile(r"\$?[A-Za-z_][A-Za-z0-9_.]*", re.ASCII)
#: A run of words and numbers, as names have them; a key has digits in between.
_WORDS = re.compile(r"[A-Za-z]*[0-9]*(?:[_.\-]+[A-Za-z]*[0-9]*)*", re.ASCII)
_SCHEME = re.compile(r"(?i)(?:bearer|basic|token)\x20+(?=[A-Za-z0-9])")
_AND = re.compile(r"[\x20\t]*(?:\+|\.(?=\x20*[\"'$])|&(?!&))[\x20\t]*(?:\\?\r?\n[\x20\t]*)?")
_OR = re.compile(r"[\x20\t]*(?:\|\||\?\?|\bor\b)[\x20\t]*")
_GAP, _WIDE_GAP = re.compile(r"[\x20\t]+(?=[rbfu]?[\"'])"), re.compile(r"[\x20\t\r\n]*(?=[rbfu]?[\"'])")
_OPEN = re.compile(r"\([\x20\t\r\n]*")
_NEXT_LINE = re.compile(r"[\x20\t]*\\?\r?\n[\x20\t]*(?=[rbfu]?[\"'`])")
#: ``condition ?`` before a literal, and ``if condition else`` behind one.
_CONDITION = re.compile(r"(?:[^\n;,:\"'`?={}]|[=!<>]=+)+\?[\x20\t]*(?=[rbfuL@$]?[\"'`])")
_ELSE = re.compile(r"[\x20\t]+if\b(?:[^\n;\"'=]|[=!<>]=|\"[^\"\n]*\"|'[^'\n]*')*?\belse[\x20\t]+")
_OTHERWISE = re.compile(r"[\x20\t]*:[\x20\t]*")
_JOIN = re.compile(r"\.join\([\x20\t\r\n]*[\[(][\x20\t\r\n]*")
_TEMPLATE = re.compile(r"\$?\{[\x20]*(?P<name>[A-Za-z_][A-Za-z0-9_.]*)[\x20]*\}")
#: The head of a private key in PEM form, which is a secret whatever it is called.
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")


def name_score(name: str) -> int:
    """How sensitive a name is, by its parts: they end at marks, digits and changes of case, and up to three make a word."""
    parts = [p.lower() for p in _PART.findall(name)]
    if not parts or parts[-1] in _ABOUT and len(parts) > 1:
        return 0
    best = max((SENSITIVE[m[0]] for m in _WITHIN.finditer("".join(parts))), default=0)
    for k in range(len(parts)):
        for n in (1, 2, 3):
            word = "".join(parts[k : k + n])
            best = max(best, SENSITIVE.get(word, 0), SENSITIVE.get(word.removesuffix("s"), 0))
    return best


def literal_score(literal: str) -> float:
    """0 to 3: entropy of the characters, how many kinds there are, and length.

    A literal with spaces may be a passphrase or a sentence, so only a name that is sure makes it a secret.
    """
    if len(literal) < 8 or _PLACEHOLDER.match(literal):
        return 0.0
    return _looks(Counter(literal))


def _looks(counts: dict[str, int]) -> float:
    """How much a literal of these characters, that is long enough and no placeholder, looks like a key."""
    if " " in counts:
        return 0.5
    n = sum(counts.values())
    entropy = -math.fsum(c / n * math.log2(c / n) for c in counts.values())
    used = "".join(counts)
    kinds = sum(bool(re.search(p, used)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, entropy / 4) + min(1.0, (kinds - 1) / 2) + min(1.0, n / 24)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end), ascending."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class _Values:
    """Reads values: each is a list of alternatives, and each of these a list of parts in order.

    A part is a literal's (start, end) or the name of a constant.
    """

    def __init__(self, text: str) -> None:
        self.text = text

    def arguments(self, at: int, lookup: bool) -> tuple[list, int]:
        """Literal arguments of a call, from behind its bracket, and of calls within it; where reading ended."""
        text, found = self.text, []
        calls, named = [[lookup, 0]], int(lookup)  # of each open call whether it looks up and its argument's number; in how many names are read
        while calls:
            while at < len(text) and text[at] in " \t\r\n":
                at += 1
            here = text[at : at + 1]
            if here == ")":
                looked, k = calls.pop()
                named -= looked and k == 0
                at += 1
            elif here == ",":
                named -= calls[-1][0] and calls[-1][1] == 0
                calls[-1][1] += 1
                at += 1
            elif (m := _CALL.match(text, at)) and _STRING.match(text, at) is None:
                if m["open"] == "[":
                    return found, m.end()
                calls.append([bool(_LOOKUP.search(m["callee"])), 0])
                named += calls[-1][0]
                at = m.end()
            else:
                parts, end = self.term(at, True)
                if not named:
                    found += parts
                at = end
                while end < len(text) and text[end] in " \t\r\n":
                    end += 1
                if text[end : end + 1] not in (",", ")"):
                    break
        return found, at

    def string(self, m: re.Match) -> list:
        """The parts of a string; those of a template are its texts and the names in it."""
        start, end = m.span(m.lastindex)
        if not (m[0][:1] in "fF`" or m[0][1:2] in "fF") or "{" not in m[0]:
            return [(start, end)]
        out, at = [], start
        for x in _TEMPLATE.finditer(self.text, start, end):
            out += [(at, x.start())] * (x.start() > at) + [x["name"]]
            at = x.end()
        return out + [(at, end)] * (end > at)

    def term(self, at: int, code: bool) -> tuple[list, int]:
        text = self.text
        if m := _STRING.match(text, at):
            if joined := _JOIN.match(text, m.end()):
                return self.listed(joined.end())
            return self.string(m), m.end()
        if m := _CALL.match(text, at):
            if m["open"] == "[":
                return [], m.end()
            return self.arguments(m.end(), bool(_LOOKUP.search(m["callee"])))
        if m := _SCHEME.match(text, at):
            at = m.end()
        if (m := _BARE.match(text, at)) is None:
            variable = _VARIABLE.match(text, at)
            return ([variable[0].lstrip("$")], variable.end()) if variable else ([], at)
        start, end = m.span()
        while end > start and text[end - 1] == ".":
            end -= 1
        word = text[start:end]
        if _WORDS.fullmatch(word):
            if code or "-" not in word:
                return ([word] if _VARIABLE.fullmatch(word) else []), m.end()
        return [(start, end)], m.end()

    def listed(self, at: int) -> tuple[list, int]:
        """Strings and names between commas, up to what is neither."""
        text, found = self.text, []
        while True:
            m, variable = _STRING.match(text, at), _VARIABLE.match(text, at)
            if m is None and variable is None:
                return found, at
            found += self.string(m) if m else [variable[0].lstrip("$")]
            at = (m or variable).end()
            while at < len(text) and text[at] in " \t\r\n,])":
                at += 1
                if text[at - 1] in ")]":
                    return found, at

    def block(self, at: int, start: int) -> list[list]:
        """The lines below that are indented further than the line in which the name starts."""
        text, out = self.text, []
        line = _LINE.match(text, text.rfind("\n", 0, start) + 1)
        while at < len(text) and (m := _LINE.match(text, at)) and (not m[2] or len(m[1]) > len(line[1])):
            out += [(m.start(2), m.end(2))] * bool(m[2])
            at = m.end()
        return [out] if out else []

    def read(self, at: int, code: bool) -> tuple[list[list], int]:
        text = self.text
        if m := _NEXT_LINE.match(text, at):
            at = m.end()
        opened = _OPEN.match(text, at)
        at = opened.end() if opened else at
        asked = _CONDITION.match(text, at)
        at = asked.end() if asked else at
        out, parts = [], []
        while True:
            found, end = self.term(at, code)
            parts = parts + found
            if m := _AND.match(text, end):
                at = m.end()
            elif found and isinstance(found[-1], tuple) and (m := (_WIDE_GAP if opened else _GAP).match(text, end)) and m.end() > end:
                at = m.end()
            elif m := _OR.match(text, end) or (found and _ELSE.match(text, end)) or (asked and _OTHERWISE.match(text, end)):
                out.append(parts)
                parts, at = [], m.end()
            else:
                break
            if at <= end and not found:
                break
        return [x for x in [*out, parts] if x], end


def _several(text: str, values: _Values) -> Iterator[tuple[int, int, list[tuple[str, list[list]]]]]:
    """(start, end of the names, pairs) of ``a, b = x, y`` with as many values as names."""
    for m in _LIST.finditer(text):
        if (equals := _EQUALS.match(text, m.end())) is None:
            continue
        names, found, at = [x.strip() for x in m[0].split(",")], [], equals.end()
        while len(found) < len(names):
            value, end = values.read(at, True)
            found.append(value)
            comma = _COMMA.match(text, end)
            if comma is None or end == at:
                break
            at = comma.end()
        if len(found) == len(names):
            yield m.start(), m.end(), [*zip(names, found, strict=True)]


def assignments(text: str) -> Iterator[tuple[int, tuple[str, ...], list[list]]]:
    """(place, names, value) of all that the lexer reads, in no order; see ``_Values`` for values."""
    values = _Values(text)
    several = [*_several(text, values)]
    taken = {end for _, end, _ in several}
    for start, _, pairs in several:
        for name, value in pairs:
            yield start, (name,), value
    for m in _HEAD.finditer(text):
        if m["name"] and m.end("name") in taken:  # the last of several names
            continue
        names = tuple(x for x in (m["name"] or m["go"], m["type"]) if x)
        if m["sep"] == ":" and (block := _BLOCK.match(text, m.end())):
            yield m.start(), names, values.block(block.end(), m.start())
            continue
        # ``x = y`` and ``x := y`` are code, where a word is a name; in ``x=y`` and ``x: y`` it may be a plain value.
        spaced = m["sep"] != ":" and m.end("sep") > 0 and text[m.start("sep") - 1 : m.start("sep")] in (" ", "\t")
        yield m.start(), names, values.read(m.end(), bool(m["type"] or m["go"] or m["sep"] == ":=" or spaced))[0]
        # What stands for a type may be the literal itself if it has digits and looks like a key.
        if m["type"] and not _WORDS.fullmatch(m["type"]) and literal_score(m["type"]) >= 2.5:
            yield m.start(), (m["name"],), [[m.span("type")]]
    for heads, code in ((_SETTER, True), (_DECLARED, True), (_DEFINE, True), (_SETS, True), (_FLAG, False)):
        for m in heads.finditer(text):
            yield m.start(), (m["name"],), values.read(m.end(), code)[0]
    for m in _ELEMENT.finditer(text):
        names = (m["tag"], *(x["name"] for x in _KEYED.finditer(m["attributes"])))
        if m["data"] is not None:
            yield m.start(), names, [[m.span("data")]] if m["data"] else []
        elif _STRING.match(m["body"]) is None:
            yield m.start(), names, [[m.span("body")]]
    for m in _KEYED.finditer(text):
        if value := _VALUED.match(text, m.end()):
            yield m.start(), (m["name"],), values.read(value.end(), True)[0]


class _Shared:
    """Scores of what many starts reach, as ``literal_score`` gives them, each definition gone through once.

    A start or definition hangs on the one that it names, if that names others in turn; of those that don't, on the longest.
    In this forest a walk from the roots up keeps count of the characters of what lies below: a literal counts where it
    first comes in and until it last goes out, so that it counts once however often it is named. What names two definitions
    that name others, or lies in a circle, is read for itself, and so is what hangs on it.
    """

    HEAD = 16

    def __init__(self, text: str, defined: dict, definition: Callable) -> None:
        self.text, self.defined, self.definition = text, defined, definition
        self.parts: dict[tuple, list] = {}
        self.places: dict[tuple, int] = {}
        self.refs: dict[tuple, list] = {}

    def named(self, node: tuple) -> list:
        """The definitions that a node names, itself apart, once each."""
        found = (self.definition(x, self.places[node]) for x in self.parts[node] if not isinstance(x, tuple) and x in self.defined)
        return list(dict.fromkeys(x for x in found if x != node))

    def scores(self, starts: list[tuple[int, list]]) -> list[float]:
        for k, (at, parts) in enumerate(starts):
            self.places[k,], self.parts[k,] = at, parts
        todo = [(k,) for k in range(len(starts))]
        while todo:
            node = todo.pop()
            if node in self.refs:
                continue
            if len(node) == 2:
                places, parts = self.defined[node[0]]
                self.places[node], self.parts[node] = places[node[1]], parts[node[1]]
            self.refs[node] = self.named(node)
            todo += self.refs[node]
        below: dict[tuple, tuple] = {}
        above: dict[tuple, list] = {}
        roots = []
        for node, refs in self.refs.items():
            deep = [x for x in refs if self.refs[x]]
            if len(deep) > 1:
                continue
            if refs:
                below[node] = deep[0] if deep else max(refs, key=lambda x: len(self.parts[x]))
                above.setdefault(below[node], []).append(node)
            else:
                roots.append(node)
        out: list[float | None] = [None] * len(starts)
        for root in roots:
            self.walk(root, below, above, out)
        return [literal_score(self.literal((k,))) if x is None else x for k, x in enumerate(out)]

    def walk(self, root: tuple, below: dict, above: dict, out: list) -> None:
        text, chars = self.text, Counter()
        held: Counter = Counter()
        heads: dict[tuple, list] = {}

        def change(key: tuple, spans: list, by: int) -> None:
            """``key`` comes in or goes out; with the first or the last of it, its spans do."""
            held[key] += by
            if held[key] == max(by, 0):
                for x in spans:
                    held[x] += by
                    if held[x] == max(by, 0):
                        count = Counter(text[x[1] : x[2]])
                        chars.update(count) if by > 0 else chars.subtract(count)

        def spans(node: tuple) -> list:
            return [("span", *x) for x in self.parts[node] if isinstance(x, tuple)]

        def turn(node: tuple, by: int) -> None:
            change(("node", node), spans(node), by)
            for x in self.refs[node]:
                if x != below.get(node):
                    change(("node", x), spans(x), by)

        todo = [(root, 1)]
        while todo:
            node, by = todo.pop()
            turn(node, by)
            if by < 0:
                del heads[node]
                continue
            heads[node] = self.head(node, below.get(node), heads)
            if len(node) == 1:
                out[node[0]] = self.score(node, {c: n for c, n in chars.items() if n}, "".join(text[s:e] for s, e in heads[node]))
            todo.append((node, -1))
            todo += [(x, 1) for x in above.get(node, ())]

    def head(self, node: tuple, below: tuple | None, heads: dict) -> list:
        """The first spans of a node, up to ``HEAD`` characters or to the end."""
        found: dict[tuple, None] = {}
        size = 0
        for x in self.parts[node]:
            if isinstance(x, tuple):
                more = [x]
            elif x not in self.defined or (ref := self.definition(x, self.places[node])) == node:
                continue
            else:
                more = heads[ref] if ref == below else [y for y in self.parts[ref] if isinstance(y, tuple)]
            for y in more:
                if y not in found:
                    found[y] = None
                    size += y[1] - y[0]
            if size >= self.HEAD:
                break
        return [*found]

    def score(self, node: tuple, chars: dict[str, int], head: str) -> float:
        n = sum(chars.values())
        if n < 8:
            return 0.0
        if n <= self.HEAD:
            return literal_score(head)
        if "\n" in chars or head[0] in "<$%":  # where the end counts too
            return literal_score(self.literal(node))
        if set(chars) <= {"x", "X"} or set(chars) in ({"*"}, {"."}) or re.match("(?i)your[_-]", head):
            return 0.0
        return _looks(chars)

    def literal(self, node: tuple) -> str:
        seen, todo, found = set(), [node], {}
        while todo:
            x = todo.pop()
            if x[0] == "span":
                found[x[1:]] = None
            elif x not in seen:
                seen.add(x)
                for y in reversed(self.parts[x]):
                    if isinstance(y, tuple):
                        todo.append(("span", *y))
                    elif y in self.defined:
                        todo.append(self.definition(y, self.places[x]))
        return "".join(self.text[s:e] for s, e in found)


def literal_spans(text: str, threshold: float = 3.5) -> list[tuple[int, int, int]]:
    """Literals that a sensitive name gets, directly or through constants, and private keys in PEM form."""
    found: set[tuple[int, int, int]] = set()
    for m in _PEM.finditer(text):
        end = _PEM_END.search(text, m.end())
        found.add((m.start(), 3, end.end() if end else m.end()))
    read = sorted(assignments(text), key=lambda x: x[0])
    defined: dict[str, tuple[list[int], list[list]]] = {}
    for at, names, value in read:
        if len(value) == 1:
            for name in {names[0], names[0].rpartition(".")[2]}:
                places, parts = defined.setdefault(name, ([], []))
                places.append(at)
                parts.append(value[0])
    scores: dict[tuple, float] = {}
    visits = 0

    def definition(name: str, at: int) -> tuple[str, int]:
        """The last one before a place, or else the first after it."""
        return name, max(0, bisect_left(defined[name][0], at) - 1)

    def resolved(parts: list, at: int) -> Iterator[tuple[int, int]]:
        """Spans of literals, those of constants among them. A definition is read once, which ends circles."""
        nonlocal visits
        seen, todo = set(), [(x, at) for x in reversed(parts)]
        while todo:
            x, at = todo.pop()
            if isinstance(x, tuple):
                yield x
            elif x in defined and (node := definition(x, at)) not in seen:
                seen.add(node)
                visits += 1
                todo += [(y, defined[x][0][node[1]]) for y in reversed(defined[x][1][node[1]])]

    sensitive = [(named, at, parts) for at, names, value in read if (named := max(map(name_score, names))) for parts in value]
    for k, (named, at, parts) in enumerate(sensitive):
        if visits > VISITS:
            rest = sensitive[k:]
            known = _Shared(text, defined, definition).scores([(at, parts) for _, at, parts in rest])
            marked: set[tuple] = set()
            for (named, at, parts), score in zip(rest, known, strict=True):
                todo = [(x, at) for x in parts] if score and named + score >= threshold else []
                while todo:
                    x, at = todo.pop()
                    if isinstance(x, tuple):
                        found |= {(x[0], 3, x[1])} if x[0] < x[1] else set()
                    elif x in defined and (node := definition(x, at)) not in marked:
                        marked.add(node)
                        todo += [(y, defined[x][0][node[1]]) for y in defined[x][1][node[1]]]
            break
        spans = tuple(dict.fromkeys(resolved(parts, at)))
        if not spans:
            continue
        if spans not in scores:
            scores[spans] = literal_score("".join(text[s:e] for s, e in spans))
        if scores[spans] and named + scores[spans] >= threshold:
            found |= {(s, 3, e) for s, e in spans if s < e}
    # Of spans that lie in one another the longest stays.
    out, reach = [], 0
    for s, k, e in sorted(found, key=lambda x: (x[0], -x[2])):
        if e > reach:
            out.append((s, k, e))
            reach = e
    return out


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans of a text, and all its spans: also literals that lie in no base span."""
    base = base_spans(text)
    starts = [s for s, _, _ in base]
    reach = [*accumulate((e for _, _, e in base), max)]
    more = [x for x in literal_spans(text) if not (k := bisect_right(starts, x[0])) or reach[k - 1] < x[2]]
    return base, sorted(base + more)


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _suspect(raw: bytes) -> bool:
    """Whether a scan can find anything: a few searches settle most texts, and those that they rule out have no spans.

    Each name that counts holds a sensitive word once what may lie between its letters is taken out.
    """
    if b"AKIA" in raw or _HEX_BYTES.search(raw):
        return True
    return bool(_ASSIGNS.search(raw) or b"-----BEGIN" in raw) and bool(_SENSITIVE_BYTES.search(raw.lower().translate(None, _BETWEEN)))


def _scan_batches(text_col: str, redact: str | None):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in rows_of(batch, batch.column("row").field(text_col), 8 << 20):
                counts, base_text, all_text, redacted = [], [], [], []
                for raw in utf8(rows.column("row").field(text_col)):
                    base, spans, text = [], [], None
                    if _suspect(raw):
                        text = raw.decode("utf-8", "replace")
                        base, spans = scan(text)
                    counts.append([sum(k == kind for _, k, _ in base) for kind in range(3)])
                    base_text.append(spelled(base))
                    all_text.append(spelled(spans))
                    redacted.append(_redacted(text, spans, redact) if redact is not None and spans else None)
                out = [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("row"), *out, pa.array(base_text, pa.string()), pa.array(all_text, pa.string()), pa.array(redacted, pa.string())],
                    names=["row", "n_assign", "n_access", "n_hex", "base_spans", "spans", "redacted"],
                )

    return run


def _redacted(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if end <= at:
            continue
        out += [text[at : max(at, start)], mask if start >= at else ""]
        at = end
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, text_col: str = "text", redact: str | None = None) -> DataFrame:
    """``docs`` as a struct ``row``, with n_assign, n_access, n_hex, base_spans, spans and redacted beside it.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then kind, comma-joined.
    ``redacted`` is the text with each span replaced by ``redact``, null if nothing was found or no mask is
    given. A null or empty text has no spans; every row is judged alone, so ids may be null or repeat and
    columns may have any names. Empty tables give no rows. There is no shuffle.
    """
    base = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    fields = [base.schema["row"], *[T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex")], *[T.StructField(c, T.StringType()) for c in ("base_spans", "spans", "redacted")]]
    return base.mapInArrow(_scan_batches(text_col, redact), T.StructType(fields))


def without_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with secrets masked; n_chars, if there is such a column, follows the text.

    All rows stay, those with null or empty texts and null or repeated ids too; a text without secrets is unchanged.
    Other columns are passed on, whatever their names. An empty table gives no rows.
    """
    done = find_secrets(docs, text_col, mask)
    change = {text_col: F.coalesce("redacted", F.col("row")[text_col])}
    if "n_chars" in docs.columns:
        change["n_chars"] = F.when(F.col("redacted").isNotNull(), F.length("redacted").cast("long")).otherwise(F.col("row")["n_chars"])
    return done.select(*[change.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
