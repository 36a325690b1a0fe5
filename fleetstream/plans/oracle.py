"""Common table expressions for the checking SQL, put together by name."""

from __future__ import annotations

import re

from fleetstream.plans.fixtures import FIXTURES, SEQD_SQL

CTES: dict[str, str] = {"seqd": SEQD_SQL}
for _name, _text in FIXTURES.items():
    _tables = {t: t for t in re.findall(r"\{(\w+)\}", _text)} | {"nl": "chr(10)"}
    CTES[_name] = _text.format(**_tables)


def cte(name: str, sql: str) -> None:
    if name in CTES:
        raise ValueError(f"CTE {name} exists")
    CTES[name] = sql


def _deps(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_0-9]+", sql))
    return [n for n in CTES if n in words]


def assemble(sql: str) -> str:
    """Put the CTEs that ``sql`` uses, and those they use, in front of it."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for d in _deps(CTES[name]):
            if d != name:
                visit(d)
        order.append(name)

    for name in _deps(sql):
        visit(name)
    if not order:
        return sql
    body = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n].strip()})" for n in order)
    recursive = "RECURSIVE " if any("/*recursive*/" in CTES[n] for n in order) else ""
    return f"WITH {recursive}{body}\n{sql.strip()}"
