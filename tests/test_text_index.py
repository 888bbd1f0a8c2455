"""The word and trigram indexes against plain scans; what they read."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions.stemming import spanish_stem
from millrace.operators.postings import IndexedSearch, TrigramIndex, WordIndex, literal_runs
from millrace.operators.search import STOP_WORDS, BooleanQuery, Search

WORDS = "casa casas casado perro perros el de niño niñez red redes mil-dos árbol 7 x".split()


def sentences(n, seed=1):
    r = random.Random(seed)
    return [(i, r.choice([None, "", " ".join(r.choice(WORDS) for _ in range(r.randrange(12)))]) if i % 5 else "de el", r.choice(["casa azul", None, "Perro"])) for i in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(sentences(120), "id long, text string, source string").withColumns({"term": F.lit("clash"), "field": F.lit(1)})


@pytest.fixture(scope="module")
def index(spark, table, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('words')}"
    return WordIndex(spark, folder, "id", ("text", "source"), stemmed=False).build(table)


QUERIES = [
    BooleanQuery.of_words("casa"),
    BooleanQuery.of_words("cas perro"),
    BooleanQuery(groups=(("casado", "perros red"),)),
    BooleanQuery(groups=(("casa",), ("niñ", "mil-")), exclude=("redes",)),
    BooleanQuery(exclude=("casa",)),
    BooleanQuery(groups=(("!!",),), exclude=("casa azul",)),
    BooleanQuery(),
    BooleanQuery.of_words("nothing-like-it"),
]


@pytest.mark.parametrize("wanted", QUERIES, ids=lambda q: q.as_text() or "empty")
def test_indexed_search_equals_the_scan(table, index, wanted):
    keys, text = ("id",), ("text", "source")
    scan = Search(keys=keys, text=text).matching(table, wanted)
    indexed = IndexedSearch(keys=keys, text=text, index=index).matching(table, wanted)
    assert sorted(r.id for r in indexed.collect()) == sorted(r.id for r in scan.collect())


def test_rows_that_share_a_key_are_one_document(spark, tmp_path):
    df = spark.createDataFrame([(1, "casa"), (1, "perro"), (2, "casa"), (None, "casa perro")], "id long, text string")
    built = WordIndex(spark, f"file://{tmp_path}/k", "id", ("text",)).build(df)
    hits = IndexedSearch(keys=("id",), text=("text",), index=built, unique=True).matching(df, BooleanQuery.of_words("casa perro"))
    assert sorted(map(tuple, hits.collect()), key=repr) == [(1, "casa"), (1, "perro"), (None, "casa perro")]


def test_postings_hold_every_position(index):
    want = {}
    for key, *texts in sentences(120):
        for field, text in zip(("text", "source"), texts):
            for pos, word in enumerate((text or "").lower().split()):
                if word not in STOP_WORDS:
                    want.setdefault((field, word, key), []).append(pos)
    got = index.postings().collect()
    assert {(r.field, r.term, r.key): r.positions for r in got} == {k: sorted(v) for k, v in want.items()} and len(got) == len(want)
    blocks = index.blocks().collect()
    assert len(blocks) < len(want) and all(r["first"] == r["keys"][0] and len(r.starts) == len(r["keys"]) + 1 for r in blocks)


def test_phrases_are_words_side_by_side(index):
    for phrase in ("casa perro", "perro de casa", "casas casas", "red 7 x"):
        words = phrase.split()
        want = {}
        for key, *texts in sentences(120):
            for field, text in zip(("text", "source"), texts):
                ws = (text or "").lower().split()
                hits = [p for p in range(len(ws)) if all(w in STOP_WORDS or (p + i < len(ws) and ws[p + i] == w) for i, w in enumerate(words))]
                if hits:
                    want[key, field] = min(hits[0], want.get((key, field), 99))
        assert {(r.key, r.field): r["first"] for r in index.phrase(phrase).collect()} == want


def test_stemmed_index_compares_stems(spark, table, tmp_path):
    stemmed = WordIndex(spark, f"file://{tmp_path}/s", "id", ("text",), stemmed=True).build(table)
    for word in ("casadas", "perra", "niños"):
        stem = spanish_stem(word)
        want = {k for k, text, _ in sentences(120) if any(spanish_stem(w).startswith(stem) for w in (text or "").split() if w not in STOP_WORDS)}
        assert {r.key for r in stemmed.keys(BooleanQuery.of_words(word), table).collect()} == want and want


def read_rows(df) -> int:
    """How many rows the scan of ``df`` gave to the filter above it."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.head().metrics().apply("numOutputRows").value()


def test_a_query_reads_the_pages_of_its_terms(spark, sf, tmp_path):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    built = WordIndex(spark, f"file://{tmp_path}/w", "doc_id", ("text",)).build(documents)
    total = built.blocks().count()
    for term in ("ther", "than"):
        wanted = built.lists([term])
        assert 0 < wanted.count() <= read_rows(wanted) < total / 4


def test_building_shuffles_lists_once(spark, table, tmp_path, monkeypatch):
    from millrace.operators import postings

    rows = []
    monkeypatch.setattr(postings, "write_sorted", lambda found, folder, *order: rows.append(found))
    WordIndex(spark, f"file://{tmp_path}/n", "id", ("text",)).build(table)
    assert "Exchange" not in rows[0]._jdf.queryExecution().executedPlan().toString()  # so that the one by ranges is all there is


# --- trigrams -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def names(spark):
    r = random.Random(5)
    rows = [(i, "".join(r.choice("abAB cé%_\\ß") for _ in range(r.randrange(24)))) for i in range(200)]
    return rows + [(200, None), (201, ""), (None, "abab cab"), (3, "aaaaaaa"), (202, "\U0001f600ab\U0001f600")]


@pytest.fixture(scope="module")
def trigrams(spark, names, tmp_path_factory):
    df = spark.createDataFrame(names, "id long, name string")
    return df, TrigramIndex(spark, f"file://{tmp_path_factory.mktemp('grams')}", "id", "name").build(df)


@pytest.mark.parametrize("length", [*range(1, 11), 15, 20])
def test_trigram_search_equals_ilike(trigrams, names, length):
    df, index = trigrams
    r = random.Random(length)
    for _ in range(2):
        text = r.choice([n for _, n in names if n and len(n) >= length] or ["a" * 20])
        at = r.randrange(max(1, len(text) - length + 1))
        term = re.sub(r"[%_\\]", lambda m: "\\" + m[0], text[at : at + length]).upper().replace("SS", "ß")
        pattern = f"%{term}%"
        want = df.filter(F.col("name").ilike(pattern))
        assert sorted(map(tuple, index.matching(df, [pattern]).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_trigram_search_with_wildcards_groups_and_exclusions(trigrams):
    df, index = trigrams
    name = F.col("name")
    for include, exclude in ((["%ab%ba%", "%c_a%"], ["%aa%"]), (["%ab", "%BAB%"], []), ([], ["%b%"]), (["abab%"], ["%zzz%"]), (["%"], [])):
        hit = F.lit(False) if include else F.lit(True)
        for p in include:
            hit = hit | name.ilike(p)
        for p in exclude:
            hit = hit & ~name.ilike(p)
        assert sorted(map(tuple, index.matching(df, include, exclude).collect()), key=repr) == sorted(map(tuple, df.filter(hit).collect()), key=repr)


def test_candidates_are_few_and_none_is_missing(trigrams):
    df, index = trigrams
    found = {r.key for r in index.candidates(["%abab%"]).collect()}
    hits = {r.id for r in df.filter(F.col("name").ilike("%abab%")).collect()}
    assert hits <= found and len(found) < 60
    assert index.candidates(["%abab%", "%ab%"]) is None  # the second has no trigram: every row is one


def test_literal_runs():
    assert literal_runs(r"%ab\%c%de_f%") == ["ab%c", "de", "f"] and literal_runs("%_") == [] and literal_runs("\\") == []
