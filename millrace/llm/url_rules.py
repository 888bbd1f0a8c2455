"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression over ``host || path`` together with the
literal tokens that any URL it matches must hold. One grouped aggregation counts
how often those literals occur in the URLs; each rule is then filed under its
rarest one. A URL looks up its own tokens and runs only the expressions found.

Up to ``MAX_RULES`` rules the lookup table is part of the plan (a map literal), so
judging is one narrow projection: no join, no shuffle, and a host that owns a third
of the URLs costs what any other costs. More rules are a table: the tokens of each
distinct URL join it, the candidates' expressions run behind the join, and the best
rule of a URL is joined back (adaptive execution splits a frequent token or URL).

Defined results: a null URL, or one without ``://``, has an empty host and path
and the default verdict; repeated rows are judged one by one; an empty table
gives an empty result; of equally long rules the greater rule string wins.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import free_names

MAX_RULES = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN_GAP = r"[^\p{L}\p{N}]+"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host || path; ``literals`` are whole tokens it needs."""

    verdict: str
    pattern: str
    literals: tuple[str, ...]
    label: str | None = None  # of an explicit host/path rule; None for a pattern rule
    length: int = 0


def _whole_tokens(literal: str, closed_right: bool) -> list[str]:
    parts = [p for p in re.split(r"[\W_]+", literal) if p]
    if parts and not closed_right and not re.search(r"[\W_]$", literal):
        parts.pop()  # the URL's token may go on
    return parts


def host_path_rule(verdict: str, rule: str) -> Rule:
    """``example.com/en/7``: that host and its subdomains, paths from ``/en/7`` on."""
    host, slash, rest = rule.partition("/")
    literals = _whole_tokens(host, True) + _whole_tokens(slash + rest, False)
    return Rule(verdict, rf"^(?:[^/]*\.)?{_quote(host)}(?:{_quote(slash + rest)}{'' if rest or slash else '(?:/|$)'})", tuple(literals), rule, len(rule))


def _quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)


def host_label_rule(verdict: str, *words: str) -> Rule:
    """A host in which the words follow one another, set off by dots or dashes."""
    return Rule(verdict, rf"^(?:[^/]*[.-])?{'-'.join(map(_quote, words))}[.-]", tuple(words))


#: Explicit rules: fixed values of the query's contract.
CONTRACT_RULES = (
    host_path_rule("block", "com/en/"),
    host_path_rule("allow", "example.com/en/7"),
    host_path_rule("allow", "net/de/"),
    host_path_rule("block", "example.net/de/8"),
    host_path_rule("block", "org/es/"),
)

#: Pattern rules for everything else: host words of unwanted categories.
CATEGORY_RULES = tuple(
    host_label_rule("block", *words)
    for words in (("adult",), ("porn",), ("xxx",), ("casino",), ("free", "bets"), ("cheap", "pills"), ("spam", "farm"), ("ads", "track"), ("malware",), ("phishing",))
)


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def literal_counts(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> dict[str, int]:
    """In how many URLs each rule literal occurs; one small row a literal."""
    wanted = sorted({t for r in rules for t in r.literals})
    tokens = F.array_distinct(F.split(F.concat(host_of(F.col(url)), path_of(F.col(url))), TOKEN_GAP))
    held = F.array_intersect(tokens, F.array(*map(F.lit, wanted)))
    rows = pages.select(F.explode(held).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["token"]: r["n"] for r in rows}


def index_by_rarest(rules: Sequence[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    filed: dict[str, list[Rule]] = {}
    for r in rules:
        if not r.literals:
            raise ValueError(f"a rule needs a literal token: {r.pattern}")
        filed.setdefault(min(r.literals, key=lambda t: (counts.get(t, 0), t)), []).append(r)
    return filed


def judge(pages: DataFrame, rules: Sequence[Rule], *, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict; these replace columns of the same name."""
    if not rules:
        raise ValueError("at least one rule")
    source = F.col(url)
    out = pages.withColumns({"host": host_of(source), "path": path_of(source)}) if url not in ("host", "path") else pages
    if len(rules) > MAX_RULES:
        return _judge_by_join(out, rules, default)
    index = index_by_rarest(rules, literal_counts(pages, rules, url))

    def literal(r: Rule) -> Column:
        return F.struct(
            F.lit(int(r.label is not None)).alias("explicit"),
            F.lit(r.length).alias("length"),
            F.lit(r.label).cast("string").alias("label"),
            F.lit(r.verdict).alias("verdict"),
            F.lit(r.pattern).alias("pattern"),
        )

    filed = F.create_map(*(x for token, own in sorted(index.items()) for x in (F.lit(token), F.array(*map(literal, own)))))
    keys = F.array(*(F.lit(t) for t in sorted(index)))
    subject = F.concat("host", "path")
    fetched = F.array_intersect(F.split(subject, TOKEN_GAP), keys)
    candidates = F.flatten(F.transform(fetched, lambda t: F.try_element_at(filed, t)))
    fitting = F.filter(candidates, lambda r: F.regexp_like(subject, r["pattern"]))
    best = F.array_max(fitting)
    return out.withColumns({"rule": best["label"], "verdict": F.coalesce(best["verdict"], F.lit(default))})


def _judge_by_join(out: DataFrame, rules: Sequence[Rule], default: str) -> DataFrame:
    """``out`` (with host and path) judged by a table of rules."""
    spark, (subject, found) = out.sparkSession, free_names(out, "subject", "found")
    if not all(r.literals for r in rules):
        raise ValueError("a rule needs a literal token")
    keyed = out.withColumn(subject, F.concat("host", "path"))
    urls = keyed.select(F.col(subject).alias("u")).groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    tokens = urls.select("u", "n", F.explode(F.array_distinct(F.split("u", TOKEN_GAP))).alias("token"))
    rows = [(i, int(r.label is not None), r.length, r.label, r.verdict, r.pattern) for i, r in enumerate(rules)]
    table = spark.createDataFrame(rows, "id long, explicit int, length int, label string, verdict string, pattern string")
    literals = spark.createDataFrame([(i, t) for i, r in enumerate(rules) for t in set(r.literals)], "id long, token string")
    counts = tokens.join(literals.select("token").distinct(), "token").groupBy("token").agg(F.sum("n").alias("n"))
    rarest = literals.join(counts, "token", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token"))["token"].alias("token"))
    candidates = tokens.select("u", "token").join(rarest.join(table, "id"), "token").filter(F.regexp_like("u", F.col("pattern")))
    best = candidates.groupBy("u").agg(F.max(F.struct("explicit", "length", "label", "verdict", "pattern")).alias(found)).withColumnRenamed("u", subject)
    kept = [c for c in out.columns if c not in ("rule", "verdict")]
    return keyed.join(best, subject, "left").select(*kept, F.col(found)["label"].alias("rule"), F.coalesce(F.col(found)["verdict"], F.lit(default)).alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    from millrace.llm.common import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, CONTRACT_RULES + CATEGORY_RULES).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    explicit = " UNION ALL ".join(f"SELECT '{r.label.partition('/')[0]}' h, '/{r.label.partition('/')[2]}' p, '{r.label}' lab, '{r.verdict}' v" for r in CONTRACT_RULES)
    words = "|".join("-".join(r.literals) for r in CATEGORY_RULES)
    return f"""
WITH u AS (SELECT row_number() OVER () rid, page_id,
    translate(regexp_extract(coalesce(url,''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') host,
    regexp_extract(coalesce(url,''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path FROM pages),
r AS ({explicit}),
m AS (SELECT rid, arg_max(lab, (length(lab), lab)) lab, arg_max(v, (length(lab), lab)) v FROM u JOIN r
      ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid)
SELECT page_id, host, path, m.lab AS rule,
  coalesce(m.v, CASE WHEN regexp_matches(host, '(^|[.-])({words})[.-]') THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN m USING (rid)"""


ORACLE = _sql()
