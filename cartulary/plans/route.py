"""From a question to a contract and an answer, by rules; a language model may replace any step.

Every step is a function of text and the catalog, so each can be exchanged: what
a model answers is checked against the catalog in the same way.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..sources.tables import fetch
from . import visuals
from .catalog import TABLES, Table, join_key, load
from .contract import Contract, compiled
from .resolve import resolved, values_of

INTENTS = ("ANALYTICAL", "CLARIFY", "UNANSWERABLE", "META", "OUT_OF_SCOPE")
_META = re.compile(r"(?i)\b(?:who are you|what can you|what data|which (?:tables|datasets)|what does .* mean|definition|help)\b")
_VAGUE = re.compile(r"(?i)^\W*(?:show me|tell me|what about|and|how about|data|numbers)?\W*(?:it|that|this|them|more)?\W*$")
_TOP = re.compile(r"(?i)\b(top|bottom|best|worst|highest|lowest|largest|smallest)\s*([0-9]{1,3})?")
_YEAR = re.compile(r"\b((?:19|20)[0-9]{2}(?:-(?:19|20)[0-9]{2})?)\b")
_TREND = re.compile(r"(?i)\b(?:trend|trends|over time|by year|yearly)\b")

#: Decisions that names alone don't make: a phrase, the table it means, and why.
POLICY = (
    ("cash flow", "accounts_nation", "what an account gains, not money between places"),
    ("by brand", "spending_nation_brand", "the only table of that grain"),
    ("sent to", "flow_nation", "directed"),
    ("received from", "flow_nation", "directed"),
)
#: Measures of which a smaller number is the better one: "best" means the smallest.
SMALLER_IS_BETTER = frozenset({"debits", "debit_ratio"})


def words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9_]+", text.lower())


def phrases(table: Table) -> set[str]:
    """What a question may call a table or its metrics."""
    said = {*table.synonyms, *(x for m in table.metrics for x in (m.name.replace("_", " "), m.label.lower(), *m.synonyms))}
    return {x for x in said if x} | {p for p, t, _ in POLICY if t == table.name}


def mentions(question: str) -> dict[str, set[str]]:
    """The phrases that a question holds, with the tables that know them; not those inside a longer one."""
    text, found = f" {' '.join(words(question))} ", {}
    known = {p: {n for n, t in TABLES.items() if p in phrases(t)} for t in TABLES.values() for p in phrases(t)}
    for p in sorted(known, key=lambda p: (-len(p), p)):
        for form in (f" {p}s ", f" {p} "):
            if form in text:
                found[p] = known[p]
                text = text.replace(form, "  ")
    return found


def tables_for(question: str) -> list[str]:
    """The fewest tables that know every measure the question mentions, in the catalog's order.

    Of tables that know as many, the one with more of the dimensions that the
    question names counts, then the one that the catalog has first.
    """
    open_phrases, asked, chosen = mentions(question), set(words(question)), []
    names = list(TABLES)
    while open_phrases:
        known = {n: sum(n in tables for tables in open_phrases.values()) for n in names}
        dimensions = {n: sum(d in asked or f"{d}s" in asked for d in TABLES[n].dimensions) for n in names}
        best = max(names, key=lambda n: (known[n], dimensions[n], -names.index(n)))
        chosen.append(best)
        open_phrases = {p: t for p, t in open_phrases.items() if best not in t}
    return sorted(chosen, key=names.index)


def intent(question: str) -> str:
    if _META.search(question):
        return "META"
    if _VAGUE.match(question):
        return "CLARIFY"
    if tables_for(question):
        return "ANALYTICAL"
    return "UNANSWERABLE" if _TOP.search(question) or "how many" in question.lower() else "OUT_OF_SCOPE"


def metric_for(question: str, table: Table) -> str:
    """The metric that the question's phrases name, the first one else."""
    found = mentions(question)
    score = [(sum(len(p) for p in found if p in {m.name.replace("_", " "), m.label.lower(), *m.synonyms}), -k, m.name) for k, m in enumerate(table.metrics)]
    return max(score)[2]


@dataclass
class Grounding:
    """What a question rests on: tables with their columns, how they join, values, periods, and what to heed."""

    tables: list[str]
    schema: dict[str, dict[str, str]] = field(default_factory=dict)  # of each table: the role or unit of each column
    joins: dict[tuple[str, str], tuple[str, str]] = field(default_factory=dict)
    values: dict[str, str] = field(default_factory=dict)  # dimension: the value that is meant
    periods: dict[str, str] = field(default_factory=dict)  # of each table
    warnings: list[str] = field(default_factory=list)


def ground(spark: SparkSession, sf_dir: str, question: str) -> Grounding:
    g = Grounding(tables_for(question))
    year = _YEAR.search(question)
    for name in g.tables:
        t = TABLES[name]
        g.schema[name] = {**{d: "dimension" for d in t.dimensions}, **({t.period: "period"} if t.period else {}), **{m.name: m.unit for m in t.metrics}}
        if t.period and (period := year[1] if year else t.default_period):
            g.periods[name] = period
        if t.period is None and year:
            g.warnings.append(f"{name} has no periods: its rows aren't of {year[1]} alone")
        if len({m.unit for m in t.metrics}) > 1:
            g.warnings.append(f"{name} has metrics of several units, which don't add up")
        df = load(spark, sf_dir, name)
        for d in t.dimensions:
            if d not in g.values and (best := resolved(values_of(df, d), question).collect()):  # one row at most
                g.values[d] = best[0]["value"]
    for k, a in enumerate(g.tables):
        for b in g.tables[k + 1 :]:
            try:
                g.joins[a, b] = join_key(a, b)
            except ValueError as e:
                g.warnings.append(str(e))
    return g


def contract_for(question: str, g: Grounding) -> Contract:
    """The contract of a question on what it rests on."""
    name = g.tables[0]
    t = TABLES[name]
    asked = set(words(question))
    entity = next((d for d in t.dimensions if d in asked or f"{d}s" in asked), t.dimensions[0])
    where = tuple((d, v) for d, v in g.values.items() if d in t.dimensions and d != entity)
    year, top, metric = _YEAR.search(question), _TOP.search(question), metric_for(question, t)
    slots = dict(table=name, metric=metric, entity=entity, where=where or None, period=year[1] if year and t.period else None)
    if len(g.tables) > 1 and (pair := next((p for p in g.joins if name in p), None)):
        other = pair[1] if pair[0] == name else pair[0]
        return Contract(operation="cross_metric", other_table=other, other_metric=metric_for(question, TABLES[other]), **slots)
    if _TREND.search(question) and t.period:
        return Contract(operation="trend", **slots | {"period": None})
    if top:
        word = top[1].lower()
        largest = word not in ("bottom", "lowest", "smallest") and not (word == "worst" and metric not in SMALLER_IS_BETTER) and not (word == "best" and metric in SMALLER_IS_BETTER)
        return Contract(operation="ranking", limit=int(top[2] or 10), largest=largest, **slots)
    if entity in g.values:
        return Contract(operation="lookup", names=(g.values[entity],), **slots)
    return Contract(operation="ranking", **slots)


@dataclass
class Answer:
    """resolution: answered, no_data, needs_clarification or unsupported; more: whether there are rows beyond these."""

    resolution: str
    text: str
    rows: list[dict] = field(default_factory=list)
    contract: Contract | None = None
    charts: list[dict] = field(default_factory=list)
    map: dict = field(default_factory=dict)
    more: bool = False


def ask(spark: SparkSession, sf_dir: str, question: str, before: Contract | None = None, most: int = 250) -> Answer:
    kind = intent(question)
    if kind == "CLARIFY" and before is None:
        return Answer("needs_clarification", "Which measure, of which places, is meant?")
    if kind == "META":
        return Answer("answered", "There is data on " + ", ".join(sorted({t.family for t in TABLES.values()})) + ".")
    if kind in ("UNANSWERABLE", "OUT_OF_SCOPE"):
        return Answer("unsupported", "The tables here don't hold that.")
    contract = Contract() if kind == "CLARIFY" else contract_for(question, ground(spark, sf_dir, question))
    if before is not None:
        contract = contract.merge(before)
    rows = fetch(compiled(spark, sf_dir, contract), most + 1)
    if not rows:
        return Answer("no_data", "No rows fit the question.", contract=contract)
    rows, more = rows[:most], len(rows) > most
    return Answer("answered", sentence(contract, rows), rows, contract, visuals.charts(contract, rows), visuals.map_for(contract, rows), more)


def sentence(contract: Contract, rows: list[dict]) -> str:
    """The first rows in words; every number is one of the rows'."""
    return f"{contract.metric}: " + "; ".join(f"{r.get('label')} {r.get('value')}" for r in rows[:5])


def faithful(text: str, rows: list[dict], tolerance: float = 0.005) -> bool:
    """Whether each number of a text is among the rows' values or labels."""
    known = [float(v) for r in rows for v in r.values() if isinstance(v, (int, float))]
    labels = " ".join(str(v) for r in rows for v in r.values() if isinstance(v, str))
    said = [float(x.replace(",", "")) for x in re.findall(r"(?<![\w.])-?[0-9][0-9,]*\.?[0-9]*(?:[eE][+-]?[0-9]+)?", text)]
    return all(any(abs(s - k) <= tolerance * max(1, abs(k)) for k in known) or f"{s:g}" in labels for s in said)
