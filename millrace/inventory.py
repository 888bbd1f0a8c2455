"""``python -m millrace.inventory`` prints which queries cover which inventory id."""

from __future__ import annotations

from millrace import catalog  # noqa: F401
from millrace.registry import ENTRIES

#: Ids that no query shows, and where they are instead.
ELSEWHERE = {
    "DQ-11": "the tests themselves: given rows, expected rows",
    "SRC-10": "`files.zip_members`, shown by a test: Spark writes no ZIP files",
    "SRC-12": "reader options of the connector (`topics.py`), shown by a test: no broker here",
    "SRC-13": "as SRC-12",
    "SRC-14": "as SRC-12",
    "SRC-21": "calls to a web service, outside the engine; the bodies are `src_23_nested_bodies`",
    "SRC-22": "as SRC-21",
    "SUP-8": "the file system's own, outside the engine",
    "SUP-16": "orchestration, outside the engine",
    "SUP-17": "uploads, outside the engine",
    "UDF-10": "calls to a model service, outside the engine",
}


def _order(item: str) -> tuple[str, int, str]:
    group, _, number = item.partition("-")
    return group, int(number) if number.isdigit() else 0, item


def lines() -> list[str]:
    by_id: dict[str, list[str]] = {}
    for entry in ENTRIES.values():
        for i in entry.ids:
            by_id.setdefault(i, []).append(f"`{entry.name}`" + ("" if entry.sql else " (no SQL)"))
    rows = {i: ", ".join(names) for i, names in by_id.items()} | ELSEWHERE
    return ["# Inventory", "", "Survey ids and the queries that show them; generated by `python -m millrace.inventory`.", "", "| Id | Queries |", "|---|---|", *(f"| {i} | {rows[i]} |" for i in sorted(rows, key=_order))]


if __name__ == "__main__":
    print("\n".join(lines()))
