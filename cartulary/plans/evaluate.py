"""Checks of answers against cases with independent SQL, and the gates over them."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from typing import Any

from .route import Answer, intent, tables_for

#: Share of cases that must hold, by gate.
GATES = {"intent": 0.9, "tables": 0.9, "result": 0.85}


@dataclass(frozen=True)
class Case:
    """expect: what CHECKS names; scalar goes with rel_tol."""

    question: str
    intent: str
    tables: tuple[str, ...] = ()
    sql: str | None = None
    expect: dict[str, Any] = field(default_factory=dict)


def load_cases(path: str) -> list[Case]:
    """Cases from a file of one JSON object a line; unknown keys and expectations are errors."""
    known, out = {f.name for f in fields(Case)}, []
    with open(path, encoding="utf-8") as f:
        for n, line in enumerate(f, 1):
            if not line.strip():
                continue
            row = json.loads(line)
            if bad := (set(row) - known) | (set(row.get("expect", {})) - set(CHECKS) - {"rel_tol"}):
                raise ValueError(f"{path}, line {n}: unknown {sorted(bad)}")
            out.append(Case(**row | {"tables": tuple(row.get("tables", ()))}))
    return out


def _near(answer: Answer, wanted: list[tuple], _: Any, tolerance: float) -> bool:
    w = float(wanted[0][-1])
    numbers = [v for v in answer.rows[0].values() if isinstance(v, (int, float))] if len(answer.rows) == 1 else []
    return any(abs(v - w) <= tolerance * max(1.0, abs(w)) for v in numbers)


def _says(answer: Answer, _: list[tuple], parts: list[str], __: float) -> bool:
    said = " ".join([answer.text, *(str(v) for r in answer.rows for v in r.values())]).lower()
    return all(p.lower() in said for p in parts)


#: What a case may expect: a test of the answer, the SQL's rows, what is expected, and the relative tolerance.
CHECKS: dict[str, Callable[[Answer, list[tuple], Any, float], bool]] = {
    "row_count": lambda answer, _, n, __: len(answer.rows) == n,
    "min_rows": lambda answer, _, n, __: len(answer.rows) >= n,
    "top_label": lambda answer, wanted, on, __: not on or bool(answer.rows and wanted and next(iter(answer.rows[0].values())) == wanted[0][0]),
    "scalar": lambda answer, wanted, on, tolerance: not on or _near(answer, wanted, on, tolerance),
    "contains": _says,
}


def holds(case: Case, answer: Answer, wanted: list[tuple]) -> bool:
    """Whether an answer is what the case expects; wanted: the rows of the case's SQL, label first.  Expecting nothing holds never."""
    tolerance = case.expect.get("rel_tol", 0.01)
    return bool(set(case.expect) & set(CHECKS)) and all(CHECKS[k](answer, wanted, x, tolerance) for k, x in case.expect.items() if k in CHECKS)


def evaluated(cases: list[Case], ask: Callable[[str], Answer], sql: Callable[[str], list[tuple]]) -> dict[str, float]:
    """The share of cases that hold, by gate; a gate without cases has 1."""
    got: dict[str, list[bool]] = {g: [] for g in GATES}
    for c in cases:
        got["intent"].append(intent(c.question) == c.intent)
        if c.tables:
            got["tables"].append(tuple(tables_for(c.question)) == c.tables)
        if c.sql:
            got["result"].append(holds(c, ask(c.question), sql(c.sql)))
    return {g: round(sum(x) / len(x), 3) if x else 1.0 for g, x in got.items()}


def passed(shares: dict[str, float]) -> bool:
    return all(shares[g] >= least for g, least in GATES.items())
