"""Verdicts on the urls of pages: listed rules first, and trust propagated over the links between hosts for the rest.

A rule names a host and a path, such as ``example.net/en/``; it fits that host and its subdomains where the url's path
starts with the rule's, and the longest fitting rule decides. Hosts are then taken as seeds: *blocked* if rules block more
than half of their pages, *trusted* if rules allow more than half. (A host without pages is judged by the urls that link to
it.) Links between different hosts, each pair of hosts counted once, carry two personalised PageRanks:

* trust starts from the trusted seeds and follows the links, shared among all hosts linked to;
* distrust starts from the blocked seeds and goes against the links, shared among all hosts linking there: who links to
  bad hosts is distrusted.

A seed starts with ``1 - DAMPING`` of its own, so scores do not depend on how many hosts there are. Mass of hosts without
further links ends there. Steps go on until no score moves by more than ``TOLERANCE``. Where no rule fits a url, its host
decides: blocked if its distrust is above ``threshold`` and above its trust, else allowed.

Everything is DataFrame work: pages are read twice (links need the html, verdicts only the url) and never shuffled with it;
links are counted map-side by pair of hosts. A step is one join and one aggregate with map-side sums over host pairs, every few
steps are written to the shared folder. Joins carry no hints: a host with a third of all pages or links is a skewed
partition of a join, which adaptive execution splits, and only counts and sums of it meet in an aggregate.

Rows: one for every page, repeated and null ids included. A null url or one without ``://`` has empty host and path, no
rule, and is allowed. Null or empty html has no links; very long html is read whole, comments and scripts are skipped. Only
the named columns are read, so others may be called anything. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitehex.llm.common import staged

BLOCK, ALLOW = "block", "allow"

# The rules that the registered query applies, with their verdicts.
RULES = (("net/", BLOCK), ("example.net/en/", ALLOW), ("example.com/de/", BLOCK), ("org/fr/", ALLOW))

DAMPING = 0.85
THRESHOLD = 0.01
TOLERANCE = 1e-4
MOST_STEPS = 60
STEPS_A_CUT = 4

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Comments and scripts are passed over whole, so that links inside them do not count; group 1 is empty there.
LINK = (
    r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script|\z)"
    r"|<a\s(?:[^<>]*?\s)?href\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s<>]*)"
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path, of a url; both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _fits(rule: str, host: Column, path: Column) -> Column:
    rule_host, slash, rest = rule.partition("/")
    return ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(slash + rest)


def match(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits (of equally long ones a blocking one, then the first by name) and its verdict."""
    by_length = sorted(rules, key=lambda r: (-len(r[0]), r[1] != BLOCK, r[0]))
    none = F.lit(None).cast("string")

    def first(answer: int) -> Column:
        return reduce(lambda rest, r: F.when(_fits(r[0], host, path), F.lit(r[answer])).otherwise(rest), by_length[::-1], none)

    return first(0), first(1)


def _judged(df: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Columns ``host, path`` with ``rule`` and its verdict."""
    rule, verdict = match(rules, F.col("host"), F.col("path"))
    return df.withColumns({"rule": rule, "verdict": verdict})


def host_links(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, url: str = "url", html: str = "html") -> DataFrame:
    """Pairs of different hosts that a page of ``source`` links to ``target``, with the number of links and what rules say of them."""
    source, _ = host_and_path(F.col(url))
    link = F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1)))
    links = pages.select(source.alias("source"), link.alias("link"))
    # A link without a scheme takes that of its page, which does not matter here.
    full = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    host, path = host_and_path(full)
    links = links.where(F.col("link") != "").select("source", host.alias("host"), path.alias("path"))
    links = links.where((F.col("source") != "") & (F.col("host") != "") & (F.col("source") != F.col("host")))
    return _judged(links, rules).groupBy("source", F.col("host").alias("target")).agg(*_tally())


def _tally() -> list[Column]:
    says = F.col("verdict")
    return [F.count("*").alias("n"), F.count_if(says == BLOCK).alias("blocked"), F.count_if(says == ALLOW).alias("allowed")]


def _hosts(judged_pages: DataFrame, links: DataFrame) -> DataFrame:
    """Every host, whether it is a seed, and the numbers of hosts it links to and is linked from."""
    zero = F.lit(0).cast("bigint")
    own = judged_pages.where(F.col("host") != "").groupBy("host").agg(*_tally())
    own = own.select("host", F.struct("n", "blocked", "allowed").alias("p"), F.lit(None).alias("l"), zero.alias("o"), zero.alias("i"))
    linked = links.groupBy(F.col("target").alias("host")).agg(
        *[F.sum(c).alias(c) for c in ("n", "blocked", "allowed")], F.count("*").alias("i")
    )
    linked = linked.select("host", F.lit(None).alias("p"), F.struct("n", "blocked", "allowed").alias("l"), zero.alias("o"), "i")
    linking = links.groupBy(F.col("source").alias("host")).agg(F.count("*").alias("o"))
    linking = linking.select("host", F.lit(None).alias("p"), F.lit(None).alias("l"), "o", zero.alias("i"))
    known = own.union(linked).union(linking).groupBy("host").agg(
        F.coalesce(F.max("p"), F.max("l")).alias("known"), F.sum("o").alias("links_out"), F.sum("i").alias("links_in")
    )
    return known.select(
        "host",
        (2 * F.col("known.allowed") > F.col("known.n")).cast("double").alias("trusted"),
        (2 * F.col("known.blocked") > F.col("known.n")).cast("double").alias("blocked"),
        "links_out",
        "links_in",
    )


def _step(hosts: DataFrame, flows: DataFrame, scores: DataFrame, damping: float) -> DataFrame:
    """The scores one step on; each host keeps its numbers of links to share its score by."""
    gives = scores.select(
        F.col("host").alias("giver"),
        F.try_divide(damping * F.col("trust"), "links_out").alias("trust"),
        F.try_divide(damping * F.col("distrust"), "links_in").alias("distrust"),
    )
    none = F.lit(0.0)
    given = flows.join(gives, "giver").select(
        F.col("taker").alias("host"),
        F.when(F.col("forward"), F.col("trust")).otherwise(none).alias("trust"),
        F.when(F.col("forward"), none).otherwise(F.col("distrust")).alias("distrust"),
        *[F.lit(0).cast("bigint").alias(c) for c in ("links_out", "links_in")],
    )
    return _start(hosts, damping).union(given).groupBy("host").agg(
        *[F.sum(c).alias(c) for c in ("trust", "distrust", "links_out", "links_in")]
    )


def _start(hosts: DataFrame, damping: float) -> DataFrame:
    own = 1 - damping
    return hosts.select(
        "host", (own * F.col("trusted")).alias("trust"), (own * F.col("blocked")).alias("distrust"), "links_out", "links_in"
    )


def propagate(hosts: DataFrame, links: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """``host, trust, distrust`` from the seeds among ``hosts`` over ``links`` (``source, target``, each pair once)."""
    forward = links.select(F.col("source").alias("giver"), F.col("target").alias("taker"), F.lit(True).alias("forward"))
    back = links.select(F.col("target").alias("giver"), F.col("source").alias("taker"), F.lit(False).alias("forward"))
    flows = forward.union(back)
    scores = _start(hosts, damping)
    if links.isEmpty():
        return scores.select("host", "trust", "distrust")
    for _ in range(0, MOST_STEPS, STEPS_A_CUT):
        for _ in range(STEPS_A_CUT - 1):
            scores = _step(hosts, flows, scores, damping)
        before = staged(scores, "rank-before")
        scores = staged(_step(hosts, flows, before, damping), "rank")
        moved = scores.union(before.select("host", -F.col("trust"), -F.col("distrust"), "links_out", "links_in"))
        by_host = moved.groupBy("host").agg(F.greatest(F.abs(F.sum("trust")), F.abs(F.sum("distrust"))).alias("by"))
        if (by_host.agg(F.max("by")).first()[0] or 0.0) <= tolerance:
            break
    return scores.select("host", "trust", "distrust")


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    id_col: str = "page_id",
    url: str = "url",
    html: str = "html",
    threshold: float = THRESHOLD,
    damping: float = DAMPING,
) -> DataFrame:
    """Per page: ``host, path``, the ``rule`` that decided (null: none) and the ``verdict``."""
    host, path = host_and_path(F.col(url))
    judged = _judged(pages.select(F.col(id_col), host.alias("host"), path.alias("path")), rules)
    links = staged(host_links(pages, rules, url, html), "host-links")
    hosts = staged(_hosts(judged, links), "hosts")
    scores = propagate(hosts, links, damping)
    bad = scores.where((F.col("distrust") > threshold) & (F.col("distrust") > F.col("trust"))).select("host", F.lit(BLOCK).alias("by_links"))
    verdict = F.coalesce("verdict", "by_links", F.lit(ALLOW))
    return judged.join(bad, "host", "left").select(id_col, "host", "path", "rule", verdict.alias("verdict"))


def _sql(rules: Sequence[tuple[str, str]], steps: int = MOST_STEPS) -> str:
    by_length = sorted(rules, key=lambda r: (-len(r[0]), r[1] != BLOCK, r[0]))

    def case(answer: int) -> str:
        lines = []
        for rule in by_length:
            host, _, rest = rule[0].partition("/")
            lines.append(
                f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{rest}') THEN '{rule[answer]}'"
            )
        return "CASE " + " ".join(lines) + " END"

    def parts(url: str) -> str:
        rest = f"CASE WHEN coalesce(instr({url}, '://'), 0) > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"
        return (
            f"translate(regexp_extract({rest}, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, "
            f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) AS path"
        )

    link = LINK.replace("'", "''")
    tally = f"count(*) AS n, count(*) FILTER (verdict = '{BLOCK}') AS b, count(*) FILTER (verdict = '{ALLOW}') AS a"
    return f"""
WITH RECURSIVE
judged AS (SELECT *, {case(0)} AS rule, {case(1)} AS verdict FROM (SELECT page_id, {parts("url")} FROM pages)),
found AS (SELECT url, unnest(regexp_extract_all(html, '{link}', 1)) AS link FROM pages),
full_links AS (
  SELECT url, CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END AS link FROM found WHERE link <> ''),
targets AS (
  SELECT source, host AS target, {case(1)} AS verdict
  FROM (SELECT (SELECT host FROM (SELECT {parts("url")})) AS source, {parts("link")} FROM full_links)
  WHERE source <> '' AND host <> '' AND source <> host),
links AS MATERIALIZED (SELECT DISTINCT source, target FROM targets),
own AS (SELECT host, {tally} FROM judged WHERE host <> '' GROUP BY host),
linked AS (SELECT target AS host, {tally} FROM targets GROUP BY target),
outs AS (SELECT source AS host, count(*) AS o FROM links GROUP BY source),
ins AS (SELECT target AS host, count(*) AS i FROM links GROUP BY target),
names AS (SELECT host FROM own UNION SELECT host FROM linked UNION SELECT host FROM outs),
hosts AS MATERIALIZED (
  SELECT host, o, i,
    {1 - DAMPING} * coalesce((2 * coalesce(own.a, linked.a) > coalesce(own.n, linked.n))::int, 0) AS t0,
    {1 - DAMPING} * coalesce((2 * coalesce(own.b, linked.b) > coalesce(own.n, linked.n))::int, 0) AS d0
  FROM names LEFT JOIN own USING (host) LEFT JOIN linked USING (host) LEFT JOIN outs USING (host) LEFT JOIN ins USING (host)),
ranked(step, host, trust, distrust) AS (
  SELECT 0, host, t0::double, d0::double FROM hosts
  UNION ALL
  SELECT step + 1, host, sum(t), sum(d) FROM (
    SELECT step, host, t0 AS t, d0 AS d FROM ranked JOIN hosts USING (host)
    UNION ALL
    SELECT step, target, {DAMPING} * trust / o, 0 FROM ranked JOIN hosts USING (host) JOIN links ON source = host
    UNION ALL
    SELECT step, source, 0, {DAMPING} * distrust / i FROM ranked JOIN hosts USING (host) JOIN links ON target = host)
  WHERE step < {steps} GROUP BY step, host),
bad AS (SELECT host FROM ranked WHERE step = {steps} AND distrust > {THRESHOLD} AND distrust > trust)
SELECT page_id, host, path, rule,
  CASE WHEN verdict IS NOT NULL THEN verdict WHEN host IN (SELECT host FROM bad) THEN '{BLOCK}' ELSE '{ALLOW}' END AS verdict
FROM judged
"""


URL_SQL = _sql(RULES)
