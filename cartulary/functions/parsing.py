"""Small texts of the catalog and of models, parsed on the driver."""

from __future__ import annotations

import hashlib
import json
import re
from typing import Any

MOST_YEARS = 200


def years_of(text: str) -> list[int]:
    """The years of "2010-2023" (any dash) or "2009, 2012"; a range and a list may mix."""
    out: list[int] = []
    for part in re.split(r"[,;]", text):
        y = [int(x) for x in re.findall(r"(?:19|20)[0-9]{2}", part)]
        if len(y) == 2 and re.search(r"[-‒-―]|to", part) and 0 <= y[1] - y[0] < MOST_YEARS:
            y = list(range(y[0], y[1] + 1))
        out += y
    return sorted(set(out))


def fenced_json(text: str) -> dict[str, Any]:
    """The JSON object of a model's reply, with or without a fence or words around it; {} if there is none."""
    for start in (m.start() for m in re.finditer(r"\{", text)):
        try:
            found, _ = json.JSONDecoder().raw_decode(text[start:])
        except ValueError:
            continue
        return found if isinstance(found, dict) else {}
    return {}


def canonical_key(value: Any) -> str:
    """SHA-256 of a value's JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
