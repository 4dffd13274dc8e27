"""URL filter, hard negatives and resampling against brute force, on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from uistrata.llm import hard_negatives, resampling, url_filter

FEATURE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Resampling.


def brute_resample(docs, targets):
    """(doc_id, n_features, weight, score, rank) by loops over dictionaries."""

    def features(text):
        words = FEATURE_WORD.findall((text or "").translate(LOWER))
        return len(words), Counter(zlib.crc32(x.encode()) % 10000 for x in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))])

    own, s, t = [(i, *features(x)) for i, x in docs], Counter(), Counter()
    for _, _, c in own:
        s.update(c)
    for x in targets:
        t.update(features(x)[1])
    S, T, out = sum(s.values()), sum(t.values()), []
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in s}
    for i, n, c in own:
        size = sum(c.values())
        weight = sum(k * gain[b] for b, k in c.items()) // size if size else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, size, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    draw = 25 * len(order) // 100
    ranks: dict = {}
    for at, r in enumerate(order[:draw], 1):
        ranks.setdefault(r, []).append(at)
    return sorted(((i, size, w, sc, ranks[key].pop(0) if ranks.get(key := (i, n, size, w, sc)) else None) for i, n, size, w, sc in out), key=repr)


def texts():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(80)] + ["straße", "中文", "a" * 40, "Z" * 300]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 90)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " .,- "), (103, "one"), (104, "the " * 700), (105, "x" * 500 + " " + "y" * 25), (None, "null id " * 20), (None, "null id " * 20), (None, None)]
    rows += [(106, " ".join(rng.choices(words, k=60_000)))] + [(107, "same text of some words " * 6)] * 5
    return rows


def test_resampling_against_loops(spark):
    rows, targets = texts(), ["the the null id", None, "straße 中文 abc", "same text of some words"]
    docs = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], "doc_id bigint, text string, uid string, score int, rank int").repartition(3)
    want = spark.createDataFrame(list(enumerate(targets)), "item_id int, text string")
    got = [tuple(r) for r in resampling.resampled(docs, want).collect()]
    assert sorted(got, key=repr) == brute_resample(rows, targets)


def test_resampling_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    one = spark.createDataFrame([(1, "a b " * 30), (2, "c")], "doc_id bigint, text string")
    assert resampling.resampled(docs, docs.withColumnRenamed("doc_id", "item_id")).collect() == []
    got = [tuple(r) for r in resampling.resampled(one, docs.withColumnRenamed("doc_id", "item_id")).collect()]
    assert sorted(got) == brute_resample([(1, "a b " * 30), (2, "c")], [])


def test_crc_of_spans():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 20_000).astype(np.uint8)
    start = rng.integers(0, 19_000, 500)
    end = start + rng.integers(0, 60, 500)
    before = np.array([zlib.crc32(b"front")] * 500, np.uint32)
    assert resampling.crc32_spans(data, start, end).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end)]
    assert resampling.crc32_spans(data, start, end, before).tolist() == [zlib.crc32(b"front" + data[a:b].tobytes()) for a, b in zip(start, end)]


def test_pairs_across_chunks(monkeypatch):
    column = pa.array(["a b c d e f g a b", None, "h", "a b a b a b"])
    whole = [x.tolist() for x in resampling.bucket_counts(column)]
    for size in (1, 2, 3):
        monkeypatch.setattr(resampling, "CHUNK", size)
        assert [x.tolist() for x in resampling.bucket_counts(column)] == whole


# Hard negatives.


def brute_negatives(rows):
    fine = [(i, [math.floor(256 * x) for x in v], (y + 1) % 10 if i is not None and i % 7 == 0 else y) for i, v, y in rows if v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    rank, out = lambda r: (-r[0], r[1] is None, r[1] or 0), []
    for k, (a, v, y) in enumerate(fine):
        if a is None or a % 100:
            continue
        scored = [(sum(p * q for p, q in zip(v, w)), b, z == y) for j, (b, w, z) in enumerate(fine) if j != k]
        for p, b, _ in sorted((r for r in scored if r[2]), key=rank)[:5]:
            fit = sorted((r for r in scored if not r[2] and 80 * p <= 100 * r[0] <= 100 * p), key=rank)[:5]
            out += [(a, b, at, n, p, s) for at, (s, n, _) in enumerate(fit, 1)]
    return sorted(out, key=repr)


def mined(spark, rows, parts=3):
    table = spark.createDataFrame([(*r, "u", 1) for r in rows], "vec_id bigint, embedding array<float>, label int, uid string, part int").repartition(parts)
    path = f"{hard_negatives.common.shared_dir(spark)}/{random.random()}"
    table.write.parquet(f"{path}/embeddings.parquet")
    return sorted((tuple(r) for r in hard_negatives.op12_hard_negatives(spark, path.removeprefix("file:") if path.startswith("file:/") else path).collect()), key=repr)


def vectors(n, dim, seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (4, dim))
    return [(i, (centres[i % 4] + rng.normal(0, spread, dim)).astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(n)]


def test_hard_negatives_against_loops(spark):
    rows = vectors(900, 12, 1, 0.4)
    rows += [(1000, None, 1), (1100, rows[0][1], None), (1200, [1.0, None], 0), (1300, [float("nan")] * 12, 0), (1400, [float("inf")] * 12, 2), (None, rows[5][1], 1), (None, rows[5][1], 1)]
    rows += [(1500, [0.0] * 12, 1), (1600, [1.0, -2.0, 3.0], 1), (1700, [], 2), (300, rows[300][1], rows[300][2])]
    rows += [(2000 + i, rows[7][1], 1) for i in range(60)]  # copies of one vector
    assert mined(spark, rows) == brute_negatives(rows)


@pytest.mark.parametrize("rows", [[], [(0, [1.0], 1)], [(0, [1.0], 1), (100, [1.0], 2)], [(0, [-1.0], 3), (1, [1.0], 3), (2, [-1.0], 4)], [(200, [3.0, 4.0], 5)] * 9 + [(201, [3.0, 4.0], 6)] * 9])
def test_few_vectors(spark, rows):
    assert mined(spark, rows, 1) == brute_negatives(rows)


def test_far_components(spark):
    rows = [(i, [float(2.0**18 * (i % 5 - 2)), float(i)], i % 2) for i in range(0, 300)]  # scores beyond 2^53
    assert mined(spark, rows) == brute_negatives(rows)
    with pytest.raises(ValueError, match="2\\^62"):
        mined(spark, [(0, [1e12], 1), (1, [1e12], 1)])


def test_brackets_hold_and_prune():
    rng = np.random.default_rng(2)
    v = np.floor(256 * (rng.normal(0, 0.2, (400, 8)) + rng.normal(0, 1, (5, 8))[rng.integers(0, 5, 400)]))
    n2, q = (v**2).sum(axis=1), v[:20]
    most = float(n2.max())
    pivots = hard_negatives.farthest_first(np.column_stack([v, np.sqrt(most - n2)]), 8)
    far = hard_negatives.pivot_distances(v, np.sqrt(most - n2), pivots)
    near = hard_negatives.pivot_distances(q, np.zeros(20), pivots)
    lists = lambda x, t: pa.array(x.tolist(), pa.list_(t))
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(range(400)), pa.array([0] * 400), lists(v.astype(int), pa.int64()), lists(far, pa.float64())], ["uid", "id", "label", "v", "d"])
    part, left = hard_negatives.Part([batch], 8, len(pivots), most), 0
    for i in range(20):
        low, high = part.brackets(np.arange(400), n2[i], near[i])
        score = v @ q[i]
        assert (low <= score).all() and (score <= high).all()
        left += int((high >= np.sort(score)[-5]).sum())
    assert left < 20 * 400 / 3  # most rows need no exact check


# URL filter.


def brute_urls(rows):
    """(page_id, host, path, rule, verdict, template): the tree by recursion over lists."""

    def parsed(url):
        _, there, rest = (url or "").partition("://")
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        path = re.split(r"[?#]", rest[cut:])[0] if there else ""
        return (rest[:cut].translate(LOWER), path) if there else ("", "")

    def rule_of(host, path):
        best = None
        for rule, verdict in url_filter.RULES:
            name, _, tail = rule.partition("/")
            if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[0])):
                best = (rule, verdict)
        return best

    def kind(seg):
        found = re.search(r"\.[A-Za-z][A-Za-z0-9]{0,4}$", seg)
        ending = found[0] if found else ""
        stem = seg[: len(seg) - len(ending)]
        if re.fullmatch(r"[0-9]+", stem):
            return url_filter.NUMBER, ending
        return (url_filter.HEX if re.fullmatch(r"(?=.*[0-9])[0-9a-fA-F-]{8,}", stem) else url_filter.ANY), ending

    pages = [(i, *parsed(u), rule_of(*parsed(u))) for i, u in rows]
    leaf, bad_all = {}, sum(p[3] is not None and p[3][1] == "block" for p in pages)

    def counts(group):
        return len(group), sum(p[3] is not None and p[3][1] == "block" for p in group), sum(p[3] is not None and p[3][1] == "allow" for p in group)

    def grow(group, template, depth, above):
        size, bad, _ = counts(group)
        under, least = (bad + 5.0 * above) / (size + 5.0), max(url_filter.LEAST, size / url_filter.SHARE)
        segs = [p[2][1:].split("/") for p in group]
        segs = [s[depth] if p[2] != "" and len(s) > depth else None for p, s in zip(group, segs)]
        own = Counter(segs)
        names = []
        for s in segs:
            if s is None:
                names.append("$")
            elif own[s] >= least:
                names.append("=" + (s if len(s) <= url_filter.NAME else "{" + hashlib.sha256(s.encode()).hexdigest()[:32] + "}"))
            else:
                names.append(kind(s))
        ended = Counter(n for n in names if isinstance(n, tuple))
        names = [(n if isinstance(n, str) else "".join(n) if ended[n] >= least else n[0]) for n in names]
        branches: dict = {}
        for p, n in zip(group, names):
            branches.setdefault(n, []).append(p)
        for members, (n, b, g) in url_filter.merged([(k, *counts(v)) for k, v in branches.items()]):
            below = [p for p, name in zip(group, names) if name in members]
            to = f"{template}/{url_filter.branch_name(members)}"
            if members != ["$"] and n >= url_filter.EXPAND and depth + 1 < url_filter.DEPTH:
                grow(below, to, depth + 1, under)
            else:
                leaf.update({(p[1], p[2]): (to, (b + 5.0 * under) / (b + g + 5.0)) for p in below})

    for host in {p[1] for p in pages}:
        grow([p for p in pages if p[1] == host], "", 0, bad_all / len(pages))
    return sorted(((i, h, p, r and r[0], r[1] if r else "block" if leaf[h, p][1] >= 0.5 else "allow", leaf[h, p][0]) for i, h, p, r in pages), key=repr)


def urls():
    rng, out = random.Random(4), []
    for host in ("a.example.net", "Shop.Example.COM", "m.example.com", "x.example.org", "spam.net", "other.de", "net", "example.net.evil.io"):
        for _ in range(150):
            end = rng.choice(["", ".html", "/", "/?q=1", "#top", f"/c/{rng.randint(1, 3)}"])
            out.append(f"http{rng.choice(['', 's'])}://{host}/{rng.choice(['en', 'de', 'fr', 'es', 'EN', f'{rng.getrandbits(48):x}'])}/{rng.choice([rng.randint(1, 9999), 'news'])}{end}")
    out += [None, "", "no scheme/en/", "x://", "x:///path", "http://a.example.net", "http://a.example.net?x=/en/", "http://a.example.net#/en/", "ftp://A.B://c/d", "mailto:x@y", "http://other.de/" + "long" * 40 + "/1", "http://other.de//", "line\nfeed://example.com/de/1\n2"]
    out += ["http://other.de/" + "long" * 40 + "/1"] * 30 + ["http://other.de/" + "/".join("abcdefghijklmnopqrstuvw")] * 60 + ["http://net/en/1"] * 40
    return list(enumerate(out)) + [(None, "http://x.example.com/de/1"), (5, out[5])]


def test_urls_against_recursion(spark):
    rows = urls()
    pages = spark.createDataFrame([(*r, "h", "p", 3) for r in rows], "page_id bigint, url string, host string, path string, n int").repartition(3)
    got = sorted((tuple(r)[:6] for r in url_filter.judged(pages).select("page_id", "host", "path", "rule", "verdict", "template").collect()), key=repr)
    assert got == brute_urls(rows)
    assert {r[4] for r in got if r[3] is None} == {"allow", "block"}  # the method decides both ways


def test_no_urls(spark):
    assert url_filter.judged(spark.createDataFrame([], "page_id bigint, url string")).collect() == []


def test_branches_of_unlike_labels_stay_apart():
    groups = url_filter.merged([("=de", 40, 40, 0), ("=en", 60, 0, 0), ("=fr", 55, 0, 0), ("$", 9, 0, 0)])
    assert [g[0] for g in groups] == [["=en", "=fr"], ["=de"], ["$"]]


def test_templates_find_what_labels_hide(spark):
    """Labels of half of the bad branch are held back: its template still gives them away, and spares the others."""
    rows = [(i, f"http://h.example.io/{'ads' if i % 3 == 0 else 'news'}/{i}", i % 3 == 0 and i % 2 == 0) for i in range(600)]
    marked = spark.createDataFrame(rows, "page_id bigint, url string, bad boolean")
    host, path = url_filter.host_and_path()
    urls_ = marked.groupBy(host.alias("host"), path.alias("path")).agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad"), F.lit(0).cast("bigint").alias("good"))
    got = {r.path: r.purity for r in url_filter.templates(urls_).collect()}
    assert all((got[f"/{'ads' if i % 3 == 0 else 'news'}/{i}"] >= 0.5) == (i % 3 == 0) for i in range(600))
