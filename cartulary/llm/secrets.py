"""Secret scans: assignment-aware lexing over the fixed base patterns.

``lexed`` reads source and configuration syntax into tokens: names, strings of one
line, of three quotes and of backticks, YAML block scalars, key blocks, bare values
after an assignment, operators and brackets with their partners.  ``assignments``
reads name-literal pairs off the tokens: ``name = "x"``, ``name: x``, ``"name": "x"``,
``name := 'x'``, ``name => "x"``, ``name["x"] = y``, ``name: type = "x"``, joined strings,
lists and the arguments of calls; and off elements and attributes of markup, flags
of commands and authorization headers.

Constants are carried on to a fixpoint: a name that is assigned another name or a
reference (``$NAME``, ``${NAME}``, ``%(name)s``, ``env.NAME``) passes its sensitivity to that
name, wherever in the text it is defined.  A literal's score is how sensitive the
most sensitive name it reaches is, times how much the literal looks like a key.
Literals above the threshold are spans of kind ``named``; those inside a base span
aren't repeated.  Nothing is bounded in length: every pattern takes what it has
begun to its end without going back, so work grows with the text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, slices, table

KINDS = ("assign", "access", "hex", "named")
#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_VALUE = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Words of target names and how sensitive they are; two words in a row count as one name.
NAME_WORDS = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "pw": 0.9, "passphrase": 1.0, "pass": 0.7, "passcode": 0.8, "pin": 0.5,
    "secret": 1.0, "secrets": 0.9, "token": 0.95, "apikey": 1.0, "bearer": 0.9, "authorization": 0.9, "credential": 0.9, "credentials": 0.9, "jwt": 0.9,
    "api key": 1.0, "access key": 1.0, "secret key": 1.0, "private key": 1.0, "signing key": 1.0, "encryption key": 1.0, "auth key": 1.0,
    "account key": 0.9, "master key": 0.95, "auth token": 1.0, "client secret": 1.0, "webhook url": 0.6, "connection string": 0.8, "salt": 0.6,
    "mnemonic": 1.0, "seed phrase": 1.0, "key store": 0.8, "keystore": 0.8,
}
#: Names whose literals may be words with spaces between them.
PHRASE_NAMES = ("passphrase", "mnemonic", "seed phrase", "password")
#: Values that stand for a secret without being one: signs, references, and whole words without a number among them.
PLACEHOLDER = re.compile(
    r"(?i)^(?:x+|\*+|\.+|-+|_+|0+|<.*>|\[.*\]|\{.*\}|\$.*|%.*|null|none|nil|true|false|undefined|password|secret|token|redacted|changeme|todo|tbd|bearer|basic"
    r"|(?:your|my|the|some|an?|example|sample|dummy|test|testing|fake|change|replace|insert|enter|put)(?:[\s_.-]+[a-z]+)*[\s_.-]*\d{0,2})$",
    re.S,
)
THRESHOLD = 0.55
LEAST_LITERAL = 6
LEAST_PHRASE_WORDS = 3
MARK = "[SECRET]"

_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_HINTS = ("pass", "pw", "secret", "token", "key", "cred", "bearer", "auth", "jwt", "webhook", "connection", "salt", "pin", "mnemonic", "seed")

_TOKEN = re.compile(
    r"""(?P<pem>-----BEGIN[ A-Z0-9]*+(?<=KEY)(?:\ BLOCK)?-----(?:(?!-----)[\s\S])*+-----END[ A-Z0-9]*+-----)
    |(?<!\w)[bfruBFRU]{0,2}(?:\"\"\"(?P<triple>(?:[^"\\]|\\[\s\S]|"(?!""))*+)\"\"\"|\'\'\'(?P<triple1>(?:[^'\\]|\\[\s\S]|'(?!''))*+)\'\'\')
    |(?<!\w)[bfruBFRU]{0,2}(?:"(?P<double>(?:[^"\\\n]|\\.)*+)"|'(?P<single>(?:[^'\\\n]|\\.)*+)'|`(?P<back>[^`\n]*+)`)
    |(?P<name>[A-Za-z_$@][\w$]*+(?:[.-][\w$]++)*+)
    |(?P<op>:=|=>|==?+|\+=|:(?![:/])|[-+.,;(){}\[\]]|\|\||\?\?)
    |(?P<line>\n)""",
    re.A | re.X,
)
_ASSIGNS = frozenset((":=", "=>", "=", "==", "+=", ":"))
_JOINS = frozenset(("+", ".", "||", "??"))
_PARTNER = {")": "(", "]": "[", "}": "{"}
_BARE = re.compile(r"""[ \t]*+(?!["'`]|[bfruBFRU]{1,2}["'])(\$\{[\w.]++\}|%\(\w++\)s|\{\{[ ]*+[\w.]++[ ]*+\}\}|[^\s"'`,;(){}\[\]<>#&|]++)""", re.A)
_BLOCK = re.compile(r"[ \t]*+[|>][-+]?[1-9]?[-+]?[ \t]*+\n")
_INNER = re.compile(r"[A-Za-z_][\w.-]*+=(?!=|$)", re.A)
_REFERENCE = re.compile(r"(?:\$\{?|%\(|\{\{[ ]*+|@)?([A-Za-z_][\w$]*+(?:[.-][\w$]++)*+)(?:\}|\)s|[ ]*+\}\})?", re.A)
#: Calls whose first argument names what they fetch.
_FETCHES = re.compile(r"(?i)(?:get|getenv|env|environ|lookup|find|fetch|read|config|param|parameter|option|property|require|input|prompt)$")
_SETS = re.compile(r"(?:^|\.)(?:set|with|use|add)_?(?=[A-Z_a-z])")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*+)(?:\s[^<>]*+)?>([^<>]++)</\1\s*>", re.A)
_KEY_VALUE = re.compile(r"""(?i)\b(?:key|name|id)\s*=\s*(["'])([^"'<>\n]++)\1\s++(?:value|content)\s*=\s*(["'])([^"'<>\n]++)\3""")
_FLAG = re.compile(r"""(?<![\w-])--([A-Za-z][\w-]*+)[ \t]++(?:"([^"\n]++)"|'([^'\n]++)'|([^\s"'`-][^\s"'`]*+))""", re.A)
_BEARER = re.compile(r"(?i)\b(?:bearer|basic)[ \t]++([A-Za-z0-9._~+/=-]{16,}+)", re.A)
_KEY_BODY = re.compile(r"-----BEGIN[^-]*-----(.*?)(?:-----|$)", re.S)
_CHUNKS = re.compile(r"[A-Za-z0-9+/=_-]{16,}(?:(?:\s|\\[nr])+[A-Za-z0-9+/=_-]+)+")


def sensitivity(name: str) -> float:
    """0 to 1, by the words of a name in snake_case, kebab-case, dotted.case or camelCase."""
    words = [w.lower() for w in _NAME_PART.findall(name)]
    runs = [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]
    return max((NAME_WORDS.get(r, 0.0) for r in runs), default=0.0)


def takes_phrases(name: str) -> bool:
    said = " ".join(w.lower() for w in _NAME_PART.findall(name))
    return any(p in said for p in PHRASE_NAMES)


def likeness(literal: str, phrases: bool = False) -> float:
    """0 to 1: how much a literal looks like a key, by its length, alphabet and spread of characters.

    A key block goes by its body, and long chunks of one alphabet over several lines
    as if they were joined.  Other literals with white space count only as phrases.
    """
    literal = literal.strip()
    if m := _KEY_BODY.search(literal):
        literal = re.sub(r"\s|\\[nr]", "", m[1])
    elif _CHUNKS.fullmatch(literal):
        literal = re.sub(r"\s|\\[nr]", "", literal)
    if len(literal) < LEAST_LITERAL or PLACEHOLDER.match(literal):
        return 0.0
    if any(c.isspace() for c in literal):
        words = literal.split()
        return 0.6 if phrases and len(words) >= LEAST_PHRASE_WORDS and all(len(w) > 2 and w.isalnum() for w in words) else 0.0
    n = len(literal)
    spread = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    kinds = sum(any(f(c) for c in literal) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in literal)
    return min(1.0, 0.25 + 0.15 * min(spread, 4.0) + 0.08 * (kinds - 1) + 0.01 * min(n, 20))


Place = tuple[int, int]


@dataclass(frozen=True)
class Token:
    """kind: name, string (also block and pem: `literal`), bare, op or line; start and end of what it holds."""

    kind: str
    start: int
    end: int
    text: str = ""


@dataclass
class Assignment:
    """A target name, the places of its literals, and the names it refers to."""

    name: str
    places: list[Place]
    refers: list[str]


def block_scalar(text: str, colon: int, begin: int) -> int:
    """Where the block that begins at a line ends: before the first line with text no deeper than the colon's line."""
    line = text.rfind("\n", 0, colon) + 1
    depth = line
    while depth < colon and text[depth] in " -":
        depth += 1
    at = begin
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        own = text[at:end]
        if own.strip() and len(own) - len(own.lstrip(" ")) <= depth - line:
            break
        at = end + 1
    return min(at, len(text))


def lexed(text: str) -> Iterator[Token]:
    at = 0
    while m := _TOKEN.search(text, at):
        kind, at = m.lastgroup, m.end()
        if kind == "pem":
            yield Token("literal", *m.span())
        elif kind == "name":
            yield Token("name", *m.span(), m[0])
        elif kind == "line":
            yield Token("line", *m.span())
        elif kind != "op":
            yield Token("string", *m.span(kind), m[kind])
        else:
            yield Token("op", *m.span(), m[0])
            if m[0] == ":" and (b := _BLOCK.match(text, at)):
                end = block_scalar(text, m.start(), b.end())
                if text[b.end() : end].strip():
                    first = b.end() + len(text[b.end() : end]) - len(text[b.end() : end].lstrip())
                    yield Token("literal", first, b.end() + len(text[b.end() : end].rstrip()))
                at = end
            elif m[0] in _ASSIGNS and (v := _BARE.match(text, at)) and not (m[0] == ":" and _INNER.match(v[1])):
                yield Token("bare", *v.span(1), v[1])
                at = v.end()


class Lexed:
    """The tokens of a text, the partner of each bracket, and how many assignments come before each token."""

    def __init__(self, text: str):
        self.tokens = list(lexed(text))
        self.partner: dict[int, int] = {}
        self.before = [0]
        stack: list[int] = []
        for k, t in enumerate(self.tokens):
            self.before.append(self.before[-1] + (t.kind == "op" and t.text in _ASSIGNS))
            if t.kind == "op" and t.text in "([{":
                stack.append(k)
            elif t.kind == "op" and t.text in _PARTNER and stack and self.tokens[stack[-1]].text == _PARTNER[t.text]:
                self.partner[k] = stack.pop()
                self.partner[self.partner[k]] = k

    def op(self, k: int, *texts: str) -> bool:
        return 0 <= k < len(self.tokens) and self.tokens[k].kind == "op" and self.tokens[k].text in texts

    def target(self, k: int) -> str | None:
        """The name that the assignment at token k gives to."""
        k -= 1
        if self.op(k, "]"):
            if k not in self.partner:
                return None
            inner = self.tokens[self.partner[k] + 1]
            if inner.kind == "string":  # name["x"] = ...
                return inner.text
            k = self.partner[k] - 1  # name[] = ... or name: type[...] = ...
        if k < 0:
            return None
        t = self.tokens[k]
        if t.kind == "bare":  # name: type = ...
            return self.target(k - 1) if self.op(k - 1, ":") else None
        return t.text if t.kind in ("name", "string") and t.text else None

    def annotates(self, k: int) -> bool:
        """Whether the colon at token k gives a type to a name that is then assigned."""
        if not self.op(k, ":") or k + 1 >= len(self.tokens) or self.tokens[k + 1].kind != "bare":
            return False
        after = k + 2
        if self.op(after, "["):
            after = self.partner.get(after, after) + 1
        return self.op(after, "=")

    def arguments(self, a: int, skip_first: bool) -> list[Place]:
        """Literals between the bracket at token a and its partner, if no assignment stands there."""
        b = self.partner.get(a)
        if b is None or self.before[b] != self.before[a + 1]:
            return []
        k = a + 1
        if skip_first:
            k = next((i + 1 for i in range(k, b) if self.op(i, ",")), b)
        return [(t.start, t.end) for t in self.tokens[k:b] if t.kind in ("string", "literal")]

    def value(self, k: int) -> tuple[list[Place], list[str]]:
        """Literals and names of the value that begins at token k."""
        places: list[Place] = []
        refers: list[str] = []
        while k < len(self.tokens):
            t = self.tokens[k]
            called = None
            if t.kind in ("string", "literal"):
                places.append((t.start, t.end))
            elif t.kind == "name" or (t.kind == "bare" and (_REFERENCE.fullmatch(t.text))):
                name = _REFERENCE.fullmatch(t.text)
                called = name[1] if name else t.text
                refers.append(called)
                if t.kind == "bare" and not self.op(k + 1, "("):
                    places.append((t.start, t.end))  # a plain word: a value of its own, unless it is defined
            elif t.kind == "bare":
                places.append((t.start, t.end))
            elif self.op(k, "(", "["):
                places += self.arguments(k, False)
                k = self.partner.get(k, k)
            else:
                break
            if called and self.op(k + 1, "("):
                refers.pop()
                places += self.arguments(k + 1, bool(_FETCHES.search(called)))
                k = self.partner.get(k + 1, k + 1)
            k += 1
            if k < len(self.tokens) and self.tokens[k].kind == "op" and self.tokens[k].text in _JOINS:
                k += 1
                while k < len(self.tokens) and self.tokens[k].kind == "line":
                    k += 1
            elif not (k < len(self.tokens) and self.tokens[k].kind == "string" and self.tokens[k - 1].kind == "string" and not self.op(k + 1, *_ASSIGNS)):
                break
        return places, refers


def assignments(text: str) -> list[Assignment]:
    """All name-literal pairs of a text, in no particular order."""
    found = []
    read = Lexed(text)
    for k, t in enumerate(read.tokens):
        if t.kind == "op" and t.text in _ASSIGNS:
            if not read.annotates(k) and (name := read.target(k)):
                found.append(Assignment(name, *read.value(k + 1)))
        elif t.kind == "name" and _SETS.search(t.text) and read.op(k + 1, "("):
            found.append(Assignment(t.text, read.arguments(k + 1, False), []))
        elif t.kind == "literal" and text.startswith("-----BEGIN", t.start):
            found.append(Assignment("private_key", [(t.start, t.end)], []))
    if "</" in text or "/>" in text:
        found += [Assignment(m[1], [m.span(2)], []) for m in _ELEMENT.finditer(text)]
        found += [Assignment(m[2], [m.span(4)], []) for m in _KEY_VALUE.finditer(text)]
    if "--" in text:
        found += [Assignment(m[1], [next(m.span(g) for g in (2, 3, 4) if m[g])], []) for m in _FLAG.finditer(text)]
    return found + [Assignment("bearer", [m.span(1)], []) for m in _BEARER.finditer(text)]


def last_part(name: str) -> str:
    return re.split(r"[.]", name)[-1].lstrip("$@")


def scores(text: str) -> dict[Place, float]:
    """The score of each literal: the sensitivity that reaches its name, times its likeness."""
    found = assignments(text)
    defined: dict[str, list[Assignment]] = {}
    for a in found:
        defined.setdefault(last_part(a.name), []).append(a)
    reach = {n: max(sensitivity(a.name) for a in own) for n, own in defined.items()}
    phrases = {n: any(takes_phrases(a.name) for a in own) for n, own in defined.items()}
    for n in sorted(reach, key=lambda n: -reach[n]):  # the most sensitive first, so each name is settled when it is met
        todo = [n] if reach[n] else []
        while todo:
            at = todo.pop()
            for r in {last_part(r) for a in defined[at] for r in a.refers}:
                if r in reach and reach[r] < reach[at]:
                    reach[r] = reach[at]
                    todo.append(r)
    best: dict[Place, float] = {}
    for n, own in defined.items():
        if not reach[n]:
            continue
        for a in own:
            bare = {last_part(r) for r in a.refers}
            for p in a.places:
                literal = text[p[0] : p[1]]
                ref = _REFERENCE.fullmatch(literal)
                if ref and last_part(ref[1]) in bare and last_part(ref[1]) in defined:
                    continue  # a name that is defined here stands for its own literals
                best[p] = max(best.get(p, 0.0), reach[n] * likeness(literal, phrases[n]))
    return best


def base_spans(text: str) -> list[tuple[int, int, str]]:
    low = text.lower()
    out: list[tuple[int, int, str]] = []
    if any(w in low for w in ("passw", "secret", "token", "api")):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    return out + [(*m.span(), "hex") for m in HEX.finditer(text)]


def named_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    low = text.lower()
    if not any(c in text for c in "=:<(-") or not any(h in low for h in _HINTS):
        return []
    found = sorted(p for p, x in scores(text).items() if x >= THRESHOLD)
    if not found:
        return []
    ends, most = [], 0  # where the base spans that begin before reach to
    held = sorted(base)
    k = 0
    for a, b in found:
        while k < len(held) and held[k][0] <= a:
            most, k = max(most, held[k][1]), k + 1
        if b > most:
            ends.append((a, b, "named"))
    return ends


def ordered(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, spans (kind, start, end in code points, end exclusive) and the number of each base kind.

    A null or empty text has no spans; a text of any length is read to its end.
    Null doc_ids and repeated rows stay as they are, other columns don't matter; an
    empty table gives an empty result.
    """

    def scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch):
            rows = []
            for text in part["text"].to_pylist():
                base = base_spans(text or "")
                rows.append((*(sum(k == kind for *_, k in base) for kind in KINDS[:3]), ordered(base), ordered(base + named_spans(text or "", base))))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), lambda: scan, "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string")


def redact(text: str | None, mark: str = MARK) -> str | None:
    """The text with every run of overlapping spans replaced by the mark."""
    if not text:
        return text
    base = base_spans(text)
    out, at = [], 0
    for a, b, _ in sorted(base + named_spans(text, base)):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, mark: str = MARK) -> DataFrame:
    """All rows and columns of docs, secrets replaced in text; n_chars, where there is one, follows."""
    names = docs.columns

    def change(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch):
            texts = [redact(t, mark) for t in part["text"].to_pylist()]
            columns = list(part.columns)
            columns[names.index("text")] = pa.array(texts, part.schema.field("text").type)
            if "n_chars" in names:
                old = part["n_chars"]
                columns[names.index("n_chars")] = pa.array([n if n is None or t is None else len(t) for n, t in zip(old.to_pylist(), texts, strict=True)], old.type)
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return map_batches(docs, lambda: change, docs.schema)


def op8(spark, sf_dir: str) -> DataFrame:
    found = scanned(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
