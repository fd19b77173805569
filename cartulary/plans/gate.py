"""The gate for SQL text: one read-only query over allowed views.

Spark's own parser reads the text; what it makes of it is checked, so words in
strings and comments don't matter.  Internals of the parser are used in `_plan`
and `_relations` alone.
"""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import fetch, list_views

MOST_CHARACTERS = 12_000
# What a query may not do, as words outside of strings and comments.
FORBIDDEN = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "COPY", "EXPORT", "ATTACH", "DETACH", "INSTALL", "LOAD", "CALL", "PRAGMA", "READ_CSV", "READ_PARQUET", "READ_JSON")
_QUIET = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)
#: Functions that reach outside of the query.
OUTSIDE = re.compile(r"(?i)\b(?:reflect|java_method|try_reflect|input_file_name|read_files|from_avro)\s*\(")


class Refused(ValueError):
    pass


def _plan(spark: SparkSession, sql: str):
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise Refused("the text isn't one SQL query") from e


def _relations(plan) -> tuple[set[str], set[str], set[str]]:
    """Names of tables, of common table expressions, and kinds of nodes, in a plan and its subqueries."""
    tables, ctes, kinds, todo = set(), set(), set(), [plan]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        kinds.add(kind)
        if kind == "UnresolvedRelation":
            tables.add(".".join(node.multipartIdentifier().mkString("\0").split("\0")))
        if kind == "UnresolvedWith":
            pairs = node.cteRelations()
            for i in range(pairs.size()):
                ctes.add(pairs.apply(i)._1())
                todo.append(pairs.apply(i)._2())
        for some in (node.children(), node.innerChildren() if kind != "UnresolvedWith" else None):
            for i in range(some.size() if some is not None else 0):
                todo.append(some.apply(i))
        expressions = node.expressions()
        for i in range(expressions.size()):
            todo += _subplans(expressions.apply(i))
    return tables, ctes, kinds


def _subplans(expression) -> list:
    out, todo = [], [expression]
    while todo:
        e = todo.pop()
        if hasattr(e, "plan") and e.getClass().getSimpleName() in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "UnresolvedScalarSubquery"):
            out.append(e.plan())
        if e.getClass().getSimpleName() == "InSubquery":
            out.append(e.query().plan())
        children = e.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def checked(spark: SparkSession, sql: str, allowed: set[str] | None = None) -> str:
    """The text without a last semicolon, if the gate lets it through; else Refused."""
    text = sql.strip().rstrip(";").strip()
    if len(text) > MOST_CHARACTERS:
        raise Refused("the query is too long")
    bare = _QUIET.sub(" ", text)
    if not re.match(r"(?i)\s*(?:select|with)\b", bare):
        raise Refused("only SELECT or WITH")
    for word in FORBIDDEN:
        if re.search(rf"(?i)\b{word}\b", bare):
            raise Refused(f"{word} isn't allowed")
    if OUTSIDE.search(bare):
        raise Refused("a function that reaches outside of the query")
    plan = _plan(spark, text)
    tables, ctes, kinds = _relations(plan)
    top = plan.getClass().getSimpleName()
    if top in ("Union", "Distinct", "Intersect", "Except"):
        raise Refused("set operations belong into a subquery")
    if any("Insert" in k or "Command" in k or k.startswith(("Create", "Drop", "Alter")) for k in kinds):
        raise Refused("only queries")
    if "UnresolvedTableValuedFunction" in kinds:
        raise Refused("no table functions")
    allowed = set(list_views(spark)) if allowed is None else allowed
    if not tables - ctes:
        raise Refused("the query reads no view")
    if others := sorted(tables - ctes - allowed):
        raise Refused(f"not among the views: {', '.join(others)}")
    return text


def query(spark: SparkSession, sql: str, most: int = 250) -> DataFrame:
    """At most `most` rows of a query that the gate lets through."""
    return spark.sql(checked(spark, sql)).limit(most)


def answer(spark: SparkSession, sql: str, most: int = 250) -> list[dict]:
    return fetch(query(spark, sql, most), most)


def batch(spark: SparkSession, queries: dict[str, str], most: int = 250) -> dict[str, dict]:
    """Each query's rows and milliseconds, or why it was refused."""
    out = {}
    for name, sql in queries.items():
        began = time.perf_counter()
        try:
            out[name] = {"rows": answer(spark, sql, most)}
        except Refused as e:
            out[name] = {"error": str(e)}
        out[name]["execution_ms"] = round(1000 * (time.perf_counter() - began))
    return out
