"""URL filter: a tree of path templates per host, judged by smoothed labelled purity.

1. Rules (host suffix and path prefix, the longest wins) label the urls they fit.
2. Distinct urls are counted with their labels.  From each host's root the tree
   grows a level of path segments at a time.  A segment that at least ``LEAST``
   urls of a node and a ``SHARE``-th of them have stays as it is; all others are
   variable and become wildcards by kind (number, hexadecimal, any), with a file
   ending if that has so much support.  A node so has some two hundred branches at
   most, whatever its host.
3. Branches of a node whose counts of bad, good and unlabelled urls pass a
   chi-square test of homogeneity are merged, in order of their share of bad ones.
4. A branch with less than ``EXPAND`` urls, the end of the path, and level
   ``DEPTH`` end the tree; what follows in a path is then part of the template.
5. A template's purity is (bad + M * above) / (bad + good + M), where ``above`` is
   the share of bad ones among all urls of the node above, smoothed likewise up to
   the whole table.  At ``REJECT`` or more its urls without a rule are blocked.

Counting is map-side first, a node's branches are one bounded group, and urls meet
the branches of their node in an ordinary join, which adaptive execution splits or
broadcasts by size, so a host with a third of all pages is no single task.

Defined results: a null url, or one without ``://``, has an empty host and path,
which is a host of its own; repeated urls count as often as they occur; a segment
of over ``NAME`` characters goes by its digest; an empty table gives an empty
result; without labels nothing is blocked; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The rules of the query: host and path, verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
LEAST, SHARE, EXPAND, DEPTH = 5, 100, 20, 16
#: 1 % point of chi-square with two degrees of freedom.
CRITICAL = 9.21
M, REJECT = 5.0, 0.5
NAME = 64
END, NUMBER, HEX, ANY = "$", "{number}", "{hex}", "*"
_NODE = ["host", "template"]


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    found = [F.coalesce(F.regexp_extract(F.col(url), pattern, k), F.lit("")) for k in (1, 2)]
    return F.translate(found[0], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), found[1]


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    by_host: dict[str, list] = {}
    for rule, verdict in rules:
        name, slash, rest = rule.partition("/")
        by_host.setdefault(name, []).append(F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(slash + rest).alias("path")))
    table = F.create_map(*[x for k, v in by_host.items() for x in (F.lit(k), F.array(*v))])
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    known = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull()))
    return F.array_max(F.filter(known, lambda r: F.startswith(path, r.path)))


def _short(segment: Column) -> Column:
    return F.when(F.length(segment) > NAME, F.concat(F.lit("{"), F.substring(F.sha2(segment.cast("binary"), 256), 1, 32), F.lit("}"))).otherwise(segment)


def _kind(segment: Column) -> tuple[Column, Column]:
    """The wildcard of a segment with its file ending, and without."""
    ending = F.regexp_extract(segment, r"(\.[A-Za-z][A-Za-z0-9]{0,4})$", 1)
    stem = F.expr("left(seg, length(seg) - length(ending))")
    kind = F.when(F.rlike(stem, F.lit(r"^[0-9]+$")), NUMBER).when(F.rlike(stem, F.lit(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$")), HEX).otherwise(ANY)
    return ending, kind


def _alike(a, b) -> bool:
    """Whether two triples of counts may come from one distribution."""
    n_a, n_b = sum(a), sum(b)
    total, statistic = n_a + n_b, 0.0
    for x, y in zip(a, b):
        if x + y:
            for seen, n in ((x, n_a), (y, n_b)):
                due = (x + y) * n / total
                statistic += (seen - due) ** 2 / due
    return statistic <= CRITICAL


def merged(branches: list[tuple]) -> list[tuple[list[str], tuple]]:
    """Branches (name, n, bad, good) of a node to ([names], (n, bad, good)); the end of the path stays alone."""
    groups: list[tuple[list[str], tuple]] = []
    for name, n, bad, good in sorted(branches, key=lambda x: (x[0] == END, x[2] / x[1], x[3] / x[1], x[0])):
        own = (bad, good, n - bad - good)
        if groups and name != END:
            names, (m, b, g) = groups[-1]
            if _alike((b, g, m - b - g), own):
                groups[-1] = ([*names, name], (m + n, b + bad, g + good))
                continue
        groups.append(([name], (n, bad, good)))
    return groups


def branch_name(names: list[str]) -> str:
    """One name for merged branches: all of up to four, else the first three and how many more."""
    names = sorted(names)
    shown = names if len(names) <= 4 else [*names[:3], f"+{len(names) - 3}"]
    return shown[0] if len(shown) == 1 else "(" + "|".join(shown) + ")"


def _branches(pdf: pd.DataFrame) -> pd.DataFrame:
    """The branches of one node, two hundred or so, to a row a name: the template it leads to and that one's counts."""
    rows = []
    for names, (n, bad, good) in merged(list(pdf[["name", "n", "bad", "good"]].itertuples(index=False, name=None))):
        to = f"{pdf['template'].iloc[0]}/{branch_name(names)}"
        rows += [(name, to, n, bad, good) for name in names]
    out = pd.DataFrame(rows, columns=["name", "to", "n", "bad", "good"])
    return out.assign(host=pdf["host"].iloc[0], template=pdf["template"].iloc[0])


def _counts(*more: Column) -> list[Column]:
    return [*[F.sum(c).alias(c) for c in ("n", "bad", "good")], *more]


def _level(state: DataFrame, depth: int) -> DataFrame:
    """Urls one level further down, stored: template, its counts and what is above it, and whether it goes on."""
    segments = F.split(F.expr("substring(path, 2)"), "/")
    more = (F.col("path") != "") & (F.size(segments) > depth)
    state = state.withColumn("seg", F.when(more, F.get(segments, F.lit(depth))))
    ending, kind = _kind(F.col("seg"))
    state = state.withColumn("ending", ending).withColumn("kind", F.when(F.col("seg").isNull(), END).otherwise(kind))
    state = state.withColumn("own", F.concat(F.lit("="), _short(F.col("seg")))).withColumn("ended", F.concat("kind", "ending"))
    each = state.groupBy(*_NODE, "own", "ended", "kind").agg(*_counts(), F.min("node_n").alias("node_n"))
    enough = F.col("n") >= F.greatest(F.lit(LEAST), F.col("node_n") / SHARE)
    named = each.withColumn("name", F.when(F.col("own").isNull(), F.col("kind")).when(enough, F.col("own")).otherwise(F.col("ended")))
    named = named.groupBy(*_NODE, "name", "kind").agg(*_counts(), F.min("node_n").alias("node_n"))
    plain = F.startswith(F.col("name"), F.lit("=")) | enough
    names = named.withColumn("name", F.when(plain, F.col("name")).otherwise(F.col("kind"))).groupBy(*_NODE, "name").agg(*_counts())
    found = names.groupBy(*_NODE).applyInPandas(_branches, "name string, to string, n bigint, bad bigint, good bigint, host string, template string")
    entry = F.struct("name", F.struct("to", F.col("n"), F.col("bad"), F.col("good")))
    # Stored, so that its size is known before the urls would be shuffled: those of a common host stay where they are if it is small.
    ways = common.stored(found.groupBy(*_NODE).agg(F.map_from_entries(F.collect_list(entry)).alias("ways")), f"ways-{depth}")
    at = F.coalesce(*[F.try_element_at("ways", F.coalesce(c, F.lit(""))) for c in ("own", "ended", "kind")])
    moved = state.join(ways, _NODE).withColumn("at", at)
    above = (F.col("node_bad") + F.lit(M) * F.col("above")) / (F.col("node_n") + F.lit(M))
    out = moved.select(
        "host", "path", "n", "bad", "good", F.col("at.to").alias("template"), F.col("at.n").alias("node_n"), F.col("at.bad").alias("node_bad"), F.col("at.good").alias("node_good"), above.alias("above"),
        (F.col("seg").isNotNull() & (F.col("at.n") >= EXPAND) & F.lit(depth + 1 < DEPTH)).alias("live"),
    )
    out = common.stored(out, f"level-{depth}")
    common.discard(ways)
    return out


def templates(urls: DataFrame) -> DataFrame:
    """(host, path, template, purity) for distinct urls (host, path, n, bad, good), stored."""
    total = urls.agg(F.sum("n"), F.sum("bad")).first()
    share = (total[1] or 0) / total[0] if total[0] else 0.0
    hosts = urls.groupBy("host").agg(*[F.sum(c).alias(f"node_{c}") for c in ("n", "bad", "good")])
    state = urls.join(hosts, "host").select("host", "path", "n", "bad", "good", F.lit("").alias("template"), "node_n", "node_bad", "node_good", F.lit(share).alias("above"), F.lit(True).alias("live"))
    leaves, depth = [], 0
    while True:
        level = _level(state, depth)
        purity = (F.col("node_bad") + F.lit(M) * F.col("above")) / (F.col("node_bad") + F.col("node_good") + F.lit(M))
        leaves.append(level)
        if not level.where("live").limit(1).count():
            break
        state, depth = level.where("live"), depth + 1
    done = [x.where("not live").select("host", "path", "template", purity.alias("purity")) for x in leaves]
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    out = common.stored(every, "templates")
    common.discard(*leaves)
    common.release(urls.sparkSession)
    return out


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for every row of ``pages`` (page_id, url)."""
    host, path = host_and_path()
    parsed = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    marked = parsed.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("fit.verdict") == v).alias(c) for v, c in (("block", "bad"), ("allow", "good"))])
    urls = common.stored(marked, "urls")
    known = templates(urls)
    common.discard(urls)
    method = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    out = parsed.join(known, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"), "template", "purity")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
