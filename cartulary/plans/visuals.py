"""Charts and maps for a contract's rows.

What is drawn follows from the contract's operation and from what the catalog says
of its table: which dimension rows are about, whether that names places, and the
metric's unit.  Neither the question's words nor the columns' names are guessed at.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from .catalog import PLACES, TABLES, Metric
from .contract import Contract

Rows = list[dict[str, Any]]

#: How an axis shows each unit.
FORMATS = {"dollars": "$,.3s", "count": ",d", "share": ".1%", "ratio": ".3f"}
#: Steps of a distribution, and rows that a chart of names shows.
BINS, NAMED = 20, 25


@dataclass(frozen=True)
class Subject:
    """What the rows of a contract are about."""

    contract: Contract
    metric: Metric
    other: Metric | None
    entity: str
    level: str | None  # of the places on a map that rows are about

    @classmethod
    def of(cls, c: Contract) -> Subject | None:
        if c.table not in TABLES:
            return None
        t = TABLES[c.table]
        taken = {d for d, _ in c.where or ()}
        entity = c.entity or next((d for d in (reversed(t.dimensions) if c.operation == "breakout" else t.dimensions) if d not in taken), t.dimensions[0])
        other = TABLES[c.other_table].metric(c.other_metric) if c.operation == "cross_metric" else None
        return cls(c, t.metric(c.metric or t.metrics[0].name), other, entity, None if c.operation in ("trend", "summary") else PLACES.get(entity))


def is_number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and x == x


def _value(metric: Metric, field: str = "value") -> dict:
    return {"field": field, "type": "quantitative", "title": metric.label or metric.name, "axis": {"format": FORMATS[metric.unit]}}


def _name(field: str, kind: str = "nominal", **more: Any) -> dict:
    return {"field": field, "type": kind, **more}


def _line(s: Subject) -> tuple[str, dict]:
    return "line", {"x": _name("label", "ordinal"), "y": _value(s.metric)}


def _bars(s: Subject) -> tuple[str, dict]:
    return "bar", {"x": _value(s.metric), "y": _name("label", sort="x" if s.contract.largest is False else "-x")}


def _side_by_side(s: Subject) -> tuple[str, dict]:
    return "bar", {"x": _name("label", sort="-y"), "y": _value(s.metric), "color": _name("label")}


def _steps(s: Subject) -> tuple[str, dict]:
    return "bar", {"x": _value(s.metric) | {"bin": {"maxbins": BINS}}, "y": {"aggregate": "count", "type": "quantitative"}}


def _points(s: Subject) -> tuple[str, dict]:
    return "point", {"x": _value(s.metric), "y": _value(s.other, "other_value"), "tooltip": _name("label")}


def _grid(s: Subject) -> tuple[str, dict]:
    return "rect", {"x": _name("destination"), "y": _name("origin"), "color": _value(s.metric, "amount")}


def _slices(s: Subject) -> tuple[str, dict]:
    return "arc", {"theta": _value(s.metric, "amount"), "color": _name("destination")}


#: Of each operation that is drawn: the kind of chart, its encoding, and whether it shows every row.
CHARTS = {
    "trend": ("trend", _line, True),
    "values": ("distribution", _steps, True),
    "cross_metric": ("relation", _points, True),
    "flow_pair_total": ("flows", _grid, True),
    "flow_share": ("shares", _slices, True),
    "compare": ("comparison", _side_by_side, False),
    "ranking": ("ranking", _bars, False),
    "breakout": ("ranking", _bars, False),
    "lookup": ("comparison", _side_by_side, False),
}


def charts(contract: Contract, rows: Rows) -> list[dict]:
    """The chart of a result, or none: one row, an operation that isn't drawn, or fewer than two numbers."""
    s = Subject.of(contract)
    if s is None or contract.operation not in CHARTS or len(rows) < 2:
        return []
    kind, encode, whole = CHARTS[contract.operation]
    mark, encoding = encode(s)
    measured = [a["field"] for a in encoding.values() if a.get("type") == "quantitative" and "field" in a]
    points = [r for r in rows if all(is_number(r.get(f)) for f in measured)]
    if len(points) < 2:
        return []
    about = "period" if contract.operation == "trend" else s.entity
    title = f"{s.metric.label or s.metric.name} by {about}"
    return [{"kind": kind, "title": title, "spec": {"data": {"values": points if whole else points[:NAMED]}, "mark": {"type": mark}, "encoding": encoding}}]


def map_for(contract: Contract, rows: Rows) -> dict:
    """What a map shows: rows about places, with their level, metric and the place that they are parts of."""
    s = Subject.of(contract)
    if s is None or s.level is None or not rows:
        return {"enabled": False, "kind": "none"}
    out = {"enabled": True, "kind": "all places", "level": s.level, "metric": s.metric.name}
    focus = [v for d, v in contract.where or () if d in PLACES]
    if contract.operation.startswith("flow_"):
        out["kind"] = "flows"
    elif contract.operation in ("compare", "lookup"):
        out |= {"kind": "named places", "places": [r["label"] for r in rows]}
    elif contract.operation == "ranking" and contract.limit is not None:
        out |= {"kind": "first places", "n": min(contract.limit, len(rows))}
    if focus:
        out["focus"] = focus[0]
    return out


def measure_of_interest(contract: Contract, rows: Rows) -> str | None:
    """The column to show: the result's value, else the table's first metric that the rows hold."""
    held = [c for c in (rows[0] if rows else ()) if any(is_number(r.get(c)) for r in rows)]
    wanted = ["value", *([contract.metric] if contract.metric else []), *(m.name for m in TABLES[contract.table].metrics)]
    return next((c for c in wanted if c in held), None)


def highest(rows: Rows, measure: str) -> dict | None:
    """The row with the largest measure, the first of equal ones."""
    return max((r for r in rows if is_number(r.get(measure))), key=lambda r: r[measure], default=None)


def with_where(contract: Contract, rows: Rows) -> Rows:
    """Rows with the dimensions that the contract holds fixed, where they lack them."""
    return [{**dict(contract.where or ()), **r} for r in rows]
