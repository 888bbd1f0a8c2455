"""Issue pages: headings and items by position, pages of any length; the plan of printed summaries."""

from __future__ import annotations

import time

from millrace.catalog import QUERIES
from millrace.functions.elements import elements_of
from millrace.operators import gazette as G

ITEM = '<li class="justificado_boc"><a href="/">g</a><b>{n}</b><a href="/d">Text</a><div class="document_info">About <div class="cve">ID-{n} <a title="Vista previa" href="/boc/{n}.html">v</a></div></div></li>'


def test_marks_are_the_last_such_siblings_before():
    found = elements_of('<div><h4>a</h4><h3>no</h3><p><h4>deep</h4></p><h3 class="t u">b</h3><h4>c</h4><ul><li>x</li></ul></div>', marks=(("h4", None), ("h3", "t")))
    assert [(e["tag"], e["before"]) for e in found] == [("div", [None, None]), ("h4", [None, None]), ("h3", [1, None]), ("p", [1, None]), ("h4", [None, None]), ("h3", [1, None]), ("h4", [1, 5]), ("ul", [6, 5]), ("li", [None, None])]


def test_an_issue_is_read_in_proportion_to_its_length(spark):
    """1,200 items below 400 headings: every item once, under its own headings (a scan of the page for each of them would not end in that time)."""
    lists = "".join(f"<h4>I. PARTE {k}</h4>" * (k % 2 == 0) + f"<h5>Org {k}</h5><ul>" + "".join(ITEM.format(n=3 * k + i) for i in range(3)) + "</ul>" for k in range(400))
    pages = spark.createDataFrame([(1, f'<title>G 2026/7</title><div class="conten">{lists}</div>')], "page int, html string")
    start = time.monotonic()
    (row,) = G.parsed_issues(pages, base="https://x.org").collect()
    assert time.monotonic() - start < 90
    assert [(d.disposition, d.section, d.organization, d.identifier, d.metadata) for d in row.dispositions] == [(n, f"Parte {n // 3 // 2 * 2}", f"Org {n // 3}", f"ID-{n}", "About") for n in range(1200)]


def test_a_printed_summary_shuffles_its_items_once(spark, sf):
    """Lines are made from items that lie by document already, and are put in order once for all that is carried along them."""
    plan = QUERIES["sup_7_printed_summary"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == 1
    assert plan.count("Sort [document") == 4  # by number in a line (twice, for the first four), by line, by group
