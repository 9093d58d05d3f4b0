"""Query registry: each query pairs a Spark callable with the SQL that checks it.

Named SQL fragments (``cte``) are pulled in by name, so a check can build on the
relations of earlier stages.
"""

from __future__ import annotations

import re

QUERIES: dict = {}
CHECKS: dict = {}
FRAGMENTS: dict[str, str] = {}
#: Relations that a check computes once, however often it reads them.
MATERIALIZED: set[str] = set()

_WORD = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")


def cte(name: str, sql: str, materialized: bool = False) -> None:
    """Register a named SQL relation; it may mention relations registered before it."""
    if name in FRAGMENTS:
        raise ValueError(f"duplicate relation {name}")
    FRAGMENTS[name] = sql.strip()
    if materialized:
        MATERIALIZED.add(name)


def _needed(sql: str) -> list[str]:
    wanted, stack = set(), [sql]
    while stack:
        for word in set(_WORD.findall(stack.pop())):
            if word in FRAGMENTS and word not in wanted:
                wanted.add(word)
                stack.append(FRAGMENTS[word])
    return [name for name in FRAGMENTS if name in wanted]


def _close(sql: str, start: int) -> tuple[int, int]:
    """End of the call opened before ``start`` and position of its last top-level comma."""
    depth, comma, i = 1, -1, start
    while depth:
        c = sql[i]
        depth += c in "([" 
        depth -= c in ")]"
        if c == "," and depth == 1:
            comma = i
        i += 1
    return i - 1, comma


def nudge_rounds(sql: str) -> str:
    """Add 1e-9 inside every ``round(x, d)`` (tie guards with d = 9 excepted) and 0.0 after it, as :func:`scalars.rounded` does."""
    out, pos = [], 0
    for m in re.finditer(r"\bround\(", sql):
        if m.start() < pos:
            continue
        end, comma = _close(sql, m.end())
        if sql[comma + 1:end].strip() == "9":
            continue
        out += [sql[pos:m.start()], "(round((", nudge_rounds(sql[m.end():comma]), ") + 1e-9",
                sql[comma:end + 1], " + 0.0)"]
        pos = end + 1
    return "".join(out) + sql[pos:]


def with_relations(sql: str) -> str:
    sql = sql.strip()
    names = _needed(sql)
    body = ",\n".join(f"{n} AS {'MATERIALIZED ' * (n in MATERIALIZED)}(\n{FRAGMENTS[n]}\n)" for n in names)
    if names and re.match(r"WITH RECURSIVE\b", sql):
        sql = f"WITH RECURSIVE {body},\n{sql[15:]}"
    elif names and re.match(r"WITH\b", sql):
        sql = f"WITH {body},\n{sql[5:]}"
    elif names:
        sql = f"WITH {body}\n{sql}"
    return nudge_rounds(sql)


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its check."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = with_relations(sql)
        return fn
    return wrap


def sql_any(text: str, words) -> str:
    """SQL test that ``text`` holds one of the words."""
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def sql_case(rules, default: str) -> str:
    """SQL CASE from (condition, value) pairs."""
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rules) + f" ELSE {default} END"


def sql_list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"
