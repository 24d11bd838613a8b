"""URL filters: explicit rules, then a path-template tree per host with labelled purity.

A segment keeps its text where it is frequent on its host and becomes a wildcard where
it is variable. Branches whose labels do not differ from those of their siblings by an
exact test are merged, and so are those that differ alike. Templates are rejected by their
smoothed share of bad pages.
"""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderframe.functions.joins import join_metadata
from cinderframe.llm.lines import lower_ascii
from cinderframe.llm.shared import by_value, written

by_value(__name__)

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls.

    ``rules`` are (verdict, ``host/path``) pairs, a parameter of the caller. A rule fits its
    host and all subdomains, if the path starts with the rule's.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decided, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decided).otherwise(verdict)
    return rule, verdict


NUMBER = r"^[0-9]+(\.[a-z]+)?$"


def generalised(path: Column) -> Column:
    """The path with its numeric segments as ``{n}``; they keep their file ending."""
    token = lambda s: F.when(s.rlike(NUMBER), F.regexp_replace(s, r"^[0-9]+", "{n}")).otherwise(s)
    return F.array_join(F.transform(F.split(path, "/"), token), "/")


def path_key(host: Column, shape: Column) -> Column:
    return F.md5(F.concat(F.length(host).cast("string"), F.lit(":"), host, shape))


def difference(n: int, b: int, m: int, c: int) -> float:
    """Two-sided exact (Fisher) p-value of ``b`` bad pages among ``n`` against ``c`` among ``m``: the smaller tail, doubled."""
    total, bad = n + m, b + c

    def ways(a: int, k: int) -> float:
        return math.lgamma(a + 1) - math.lgamma(k + 1) - math.lgamma(a - k + 1)

    term = math.exp(ways(n, b) + ways(m, c) - ways(total, bad))
    more, tail, k = b * total >= n * bad, term, b
    while True:
        if more:
            term *= (n - k) * (bad - k) / ((k + 1) * (m - bad + k + 1))
            k += 1
        else:
            term *= k * (m - bad + k) / ((n - k + 1) * (bad - k + 1))
            k -= 1
        if term <= tail * 1e-12:
            return min(1.0, 2 * tail)
        tail += term


def merged_rates(rows: list[tuple[int, int, str, int]], alpha: float) -> list[int]:
    """The group of each (labelled, bad, name, branches), given in the order of rates.

    Of all neighbouring pairs the one that is most alike is merged, until every pair differs at ``alpha``.
    """
    groups = [[n, b, 1] for n, b, *_ in rows]
    alike = [difference(*a[:2], *z[:2]) for a, z in zip(groups, groups[1:])]
    while alike and max(alike) >= alpha:
        i = alike.index(max(alike))
        groups[i : i + 2] = [[x + y for x, y in zip(groups[i], groups[i + 1])]]
        del alike[i]
        for j in (i - 1, i):
            if 0 <= j < len(alike):
                alike[j] = difference(*groups[j][:2], *groups[j + 1][:2])
    return [g for g, group in enumerate(groups) for _ in range(group[2])]


def prefixes(host: str, tokens):
    """(parent, node, token) of every level: a node is the digest of all that leads to it."""
    parent = hashlib.blake2b(host.encode(), digest_size=16).digest()
    for token in tokens:
        node = hashlib.blake2b(parent + token.encode(), digest_size=16).digest()
        yield parent, node, token
        parent = node


def branches(tokenised: DataFrame, alpha: float) -> DataFrame:
    """(node, label) of the branches whose labels differ from those of their siblings.

    A branch is tested against all its siblings together; ``alpha`` is shared among
    the siblings. Those that differ are merged pairwise where they are alike, in the order of
    their rates (equal in thousandths: one), so one parent has at most 1,001 rows here.
    """

    def spread(batches):
        for batch in batches:
            rows = [(*p, n, b) for host, tokens, n, b in zip(batch["host"], batch["tokens"], batch["labelled"], batch["bad"]) for p in prefixes(host, tokens)]
            for at in range(0, len(rows), 10_000):
                yield pd.DataFrame(rows[at : at + 10_000], columns=["parent", "node", "token", "n", "b"])

    @F.pandas_udf("double")
    def chance(n: pd.Series, b: pd.Series, m: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([difference(*map(int, row)) for row in zip(n, b, m, c)], dtype="float64")

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rate").reset_index(drop=True)
        group = pd.Series(merged_rates(list(zip(rows["n"].tolist(), rows["b"].tolist(), rows["token"], rows["count"])), alpha))
        names = rows.groupby(group).agg(token=("token", "min"), count=("count", "sum"))
        label = [token if count == 1 else f"{{{token}+{count - 1}}}" for token, count in zip(names["token"], names["count"])]
        return rows[["parent", "rate"]].assign(label=[label[g] for g in group])

    labelled = tokenised.filter("labelled > 0").select("host", "tokens", "labelled", "bad")
    nodes = labelled.mapInPandas(spread, "parent binary, node binary, token string, n long, b long")
    nodes = written(nodes.groupBy("parent", "node", "token").agg(F.sum("n").alias("n"), F.sum("b").alias("b")), "url-nodes")
    totals = nodes.groupBy("parent").agg(F.sum("n").alias("all_n"), F.sum("b").alias("all_b"), F.count(F.lit(1)).alias("siblings"))
    totals = totals.filter((F.col("siblings") > 1) & (F.col("all_b") > 0) & (F.col("all_b") < F.col("all_n")))
    tested = join_metadata(nodes, totals, ["parent"]).withColumn("p", chance("n", "b", F.col("all_n") - F.col("n"), F.col("all_b") - F.col("b")))
    rate = F.floor(F.lit(1000) * F.col("b") / F.col("n"))
    apart = written(tested.filter(F.col("p") * F.col("siblings") < alpha).select("parent", "node", "token", "n", "b", rate.alias("rate")), "url-apart")
    alike = apart.groupBy("parent", "rate").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.min("token").alias("token"), F.count(F.lit(1)).alias("count"))
    groups = alike.groupBy("parent").applyInPandas(merge, "parent binary, rate long, label string")
    return apart.select("parent", "rate", "node").join(groups, ["parent", "rate"]).select("node", "label")


def templates(
    pages: DataFrame, support: int = 8, alpha: float = 0.05, id_col: str = "page_id", host_col: str = "host", path_col: str = "path", bad_col: str = "bad"
) -> DataFrame:
    """(id, host, path, bad, template): each page's template in the tree of its host.

    ``bad`` is 0, 1 or null (no label). A segment keeps its text where at least ``support`` pages of the host
    have it at that level; numbers become ``{n}``, other segments ``{*}``. A page's template ends at
    the last branch on its way that stands apart from its siblings (``branches``), named with the
    branches merged into it (``{first+others}``); what follows is ``{**}``. A page that meets no such
    branch is in its host's ``/{**}``. Nulls in host or path read as empty; an empty path
    has an empty template; repeated rows count.

    Pages are first counted by distinct path with numbers generalised, and all levels of
    these paths are counted in one grouping, so the number of jobs does not depend on their depth.
    """
    host, path = F.coalesce(host_col, F.lit("")), F.coalesce(path_col, F.lit(""))
    state = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.col(bad_col).cast("int").alias("bad")).withColumn("shape", generalised(F.col("path")))
    counted = state.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    shapes = written(counted.withColumn("key", path_key(F.col("host"), F.col("shape"))), "url-shapes")
    segments = shapes.select("key", "host", "n", "labelled", "bad", F.posexplode(F.split("shape", "/")).alias("level", "segment")).filter("level > 0")
    common = segments.groupBy("host", "level", "segment").agg(F.sum("n").alias("pages")).filter(F.col("pages") >= support)
    common = written(common.select("host", "level", "segment", F.lit(True).alias("frequent")), "url-frequent")
    plain = F.col("frequent") | (F.col("segment") == "") | F.col("segment").rlike(r"^\{n\}(\.[a-z]+)?$")
    token = F.when(plain, F.col("segment")).otherwise("{*}")
    told = join_metadata(segments, common, ["host", "level", "segment"], "left").select("key", "host", "labelled", "bad", F.struct("level", token.alias("token")).alias("step"))
    ordered = F.transform(F.array_sort(F.collect_list("step")), lambda s: s["token"])
    tokenised = written(told.groupBy("key", "host", "labelled", "bad").agg(ordered.alias("tokens")), "url-tokens")

    def visit(batches):
        for batch in batches:
            rows = [(key, level, node) for key, host, tokens in zip(batch["key"], batch["host"], batch["tokens"]) for level, (_, node, _) in enumerate(prefixes(host, tokens), 1)]
            for at in range(0, len(rows), 10_000):
                yield pd.DataFrame(rows[at : at + 10_000], columns=["key", "level", "node"])

    apart = written(branches(tokenised, alpha), "url-branches")
    met = join_metadata(tokenised.select("key", "host", "tokens").mapInPandas(visit, "key string, level int, node binary"), apart, ["node"])
    last = met.groupBy("key").agg(F.max(F.struct("level", "label")).alias("last"))
    level = F.col("last.level")
    named = F.concat(F.slice("tokens", 1, level - 1), F.array("last.label"), F.when(F.size("tokens") > level, F.array(F.lit("{**}"))).otherwise(F.array()))
    placed = tokenised.join(last, "key").select("key", F.concat(F.lit("/"), F.array_join(named, "/")).alias("template"))
    shown = join_metadata(state.withColumn("key", path_key(F.col("host"), F.col("shape"))), written(placed, "url-placed"), ["key"], "left")
    rest = F.when(F.col("path") == "", "").otherwise("/{**}")
    return shown.select("id", "host", "path", "bad", F.coalesce("template", rest).alias("template"))


def purity(placed: DataFrame, most: float = 20.0) -> DataFrame:
    """(host, template, labelled, purity): bad share of each template, smoothed towards the share of all labelled pages.

    The weight of that share, in pages, follows from how much templates differ beyond chance (the moments
    of a beta-binomial): from 1, where a template is all good or all bad, to ``most``, where they are alike.
    """
    stats = placed.groupBy("host", "template").agg(F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b"))
    stats = written(stats, "url-stats")
    base = stats.agg((F.sum("b") / F.nullif(F.sum("labelled"), F.lit(0))).alias("b")).head()["b"] or 0.0
    excess = F.sum(F.pow(F.col("b") - F.col("labelled") * F.lit(base), F.lit(2)))
    sums = stats.agg(excess.alias("excess"), F.sum("labelled").alias("n"), F.sum(F.col("labelled") * (F.col("labelled") - 1)).alias("pairs")).head()
    prior = most
    if 0 < base < 1 and sums["pairs"]:
        within = (sums["excess"] / (base * (1 - base)) - sums["n"]) / sums["pairs"]
        prior = 1 / min(max(within, 1 / (most + 1)), 0.5) - 1
    return stats.select("host", "template", "labelled", ((F.col("b") + prior * base) / (F.col("labelled") + prior)).alias("purity"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], reject: float = 0.5, id_col: str = "page_id", url_col: str = "url", bad_col: str = "bad") -> DataFrame:
    """(id, host, path, rule, verdict, template, labelled, purity) of every page.

    ``labels`` has (id, bad) for some pages. A rule decides where one fits; elsewhere a
    page is blocked if its template's smoothed share of bad pages is at least ``reject``. The tree goes as
    deep as paths do. A null url, or
    one without ``://``, has an empty host, path and template. Repeated rows get equal
    results; an empty table gives no rows; other columns are ignored.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("l_id"), F.col(f"`{bad_col}`").cast("int").alias("bad")).filter("l_id is not null").groupBy("l_id").agg(F.max("bad").alias("bad"))
    parsed = pages.select(F.col(f"`{id_col}`").alias("id"), url_host(F.col(f"`{url_col}`")).alias("host"), url_path(F.col(f"`{url_col}`")).alias("path"))
    placed = written(templates(parsed.join(known, F.col("id") == F.col("l_id"), "left").drop("l_id"), id_col="id"), "url-templates")
    judged = join_metadata(placed, written(purity(placed), "url-purity"), ["host", "template"], "left")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("purity") >= reject, "block").otherwise("allow")
    return judged.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", "labelled", "purity")
