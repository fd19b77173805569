"""Names and codes of places."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The states and the federal district with their postal codes.
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE",
    "district of columbia": "DC", "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA",
    "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN",
    "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM",
    "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI",
    "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA",
    "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
}


def postal_code(c: Column) -> Column:
    """The postal code of a state's name or code in any case; null if it is neither."""
    pairs = [F.lit(x) for name, code in STATES.items() for x in (name, code)] + [F.lit(x) for code in STATES.values() for x in (code.lower(), code)]
    return F.create_map(*pairs)[F.lower(F.trim(c))]


def state_in(question: str) -> str | None:
    """The state that a question names, the longest first."""
    low = f" {re.sub('[^a-z]+', ' ', question.lower())} "
    found = [s for s in STATES if f" {s} " in low]
    return max(found, key=len).title() if found else None
