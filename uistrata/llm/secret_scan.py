"""Secret scan with an incremental blob ledger.

Every historical version of a path is content-addressed.  The ledger, a folder
of Parquet files, holds what was found in a blob by a version of the rules;
only blobs without an entry for the current rule version are scanned, each once
however many paths and versions hold it, and findings are joined back to all.
The rule version is a hash of the rules, so changed rules never meet old findings.

Plan: one exchange moves each distinct text once (copies are dropped map-side
first) to where the ledger's blobs are looked up; findings are small rows joined
back by blob id.  A blob that two scans append at once counts once.

Defined results: null text counts as empty; offsets in code points, end
exclusive; rows with the same path are separate versions, repeated rows too;
spans of one kind never overlap, those of different kinds may, and go by start,
then kind; every pattern reads a text in time in proportion to its length; an
empty table gives an empty result; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernels

#: Base kinds, in the order that breaks ties; the method's own kinds follow.
BASE = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX_RUN = re.compile(r"[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18}
_NAMES = ("passw", "secret", "token", "api")
#: The method's own kinds: literal that must be in the text, pattern.
OWN = {
    "private_key": ("-----BEGIN", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")),
    # Starts where a run of its characters starts, so no run is read twice.
    "jwt": ("eyJ", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    "forge_token": ("gh", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")),
    "chat_token": ("xox", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}")),
    "map_key": ("AIza", re.compile(r"AIza[0-9A-Za-z_-]{35}")),
    # From the colon on; the scheme, of SCHEME characters at most, is looked for before it.
    "url_login": ("://", re.compile(r"://[^\s/:@]+:[^\s/:@]+@[^\s/]+")),
}
_SCHEME, SCHEME = re.compile(r"[a-z][a-z0-9+.-]*\Z"), 32
KINDS = (*BASE, *OWN)
_RANK = {k: i for i, k in enumerate(KINDS)}
def version(own: dict) -> str:
    """A hash of all rules: other rules, another version."""
    base = [_ASSIGN.pattern, _ACCESS.pattern, _HEX_RUN.pattern, LEAST, _SCHEME.pattern, SCHEME]
    return hashlib.sha256(repr([*base, [(k, x, p.pattern) for k, (x, p) in own.items()]]).encode()).hexdigest()[:16]


RULES = version(OWN)


def _logins(text: str, pattern: re.Pattern) -> Iterator[tuple[int, int, str]]:
    """URLs with a name and a password: scheme found backwards from the colon."""
    done = 0
    for m in pattern.finditer(text):
        low = max(done, m.start() - SCHEME)
        if scheme := _SCHEME.search(text[low : m.start()]):
            done = m.end()
            yield low + scheme.start(), done, "url_login"


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start and then kind."""
    spans = []
    low = text.lower()
    if any(x in low for x in _NAMES):
        spans += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # The long matches of [0-9a-f]+ are its maximal runs, so they can be asked for directly.
    spans += [(m.start(), m.end(), "hex") for m in _HEX_RUN.finditer(text)]
    for kind, (literal, pattern) in OWN.items():
        if literal in text:
            spans += _logins(text, pattern) if kind == "url_login" else [(m.start(), m.end(), kind) for m in pattern.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], _RANK[s[2]]))


def _joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in kernels.slices(batch.column("text"), 8 << 20):
            found = [find(x) for x in batch.column("text").slice(lo, hi - lo).to_pylist()]
            base = [[s for s in spans if s[2] in BASE] for spans in found]
            counts = [pa.array([sum(s[2] == kind for s in spans) for spans in base], pa.int64()) for kind in BASE]
            sha = [hashlib.sha256(_joined(spans).encode()).hexdigest() for spans in base]
            yield pa.RecordBatch.from_arrays([batch.column("blob").slice(lo, hi - lo), *counts, pa.array(sha), pa.array(map(_joined, found), pa.string())], ["blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


_FOUND = "blob binary, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


class Ledger:
    """Findings by (blob, rule version), kept under ``path`` (a store that Spark reads and writes)."""

    def __init__(self, spark: SparkSession, path: str, rules: str = RULES):
        self.spark, self.path, self.rules = spark, path.rstrip("/"), rules
        self.files = f"{self.path}/rules={rules}"

    def findings(self) -> DataFrame:
        """What is known under this rule version, a row per blob."""
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.files)
        if target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            return self.spark.read.schema(_FOUND).parquet(self.files).dropDuplicates(["blob"])
        return self.spark.createDataFrame([], _FOUND)

    def add(self, versions: DataFrame, text_col: str = "text") -> None:
        """Scan the blobs of ``versions`` that the ledger has not, and append what is found."""
        text = F.coalesce(F.col(text_col), F.lit(""))
        blobs = versions.select(_blob(text_col), text.alias("text")).dropDuplicates(["blob"])
        unseen = blobs.join(self.findings().select("blob"), "blob", "left_anti")
        unseen.mapInArrow(_scan, _FOUND).write.mode("append").option("compression", "zstd").parquet(self.files)

    def report(self, versions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Findings of every version whose blob is known."""
        return versions.select(F.col(id_col), _blob(text_col)).join(self.findings(), "blob")

    def scan(self, versions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Add the unseen blobs of ``versions``, then give each version its findings."""
        self.add(versions, text_col)
        return self.report(versions, id_col, text_col)


def _blob(text_col: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("blob")


def history(docs: DataFrame, id_col: str = "doc_id") -> list[DataFrame]:
    """A table as two pushes, one after the other, that together are all of it: rows of odd and of even hash."""
    push = F.pmod(F.xxhash64(id_col), F.lit(2))
    return [docs.where(push == i) for i in (0, 1)]


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pushes to one ledger, the second of which scans only what the first had not; findings of all rows."""
    docs = common.documents(spark, sf_dir)
    ledger = Ledger(spark, f"{common.shared_dir(spark)}/ledger-{uuid.uuid4().hex}")
    for push in history(docs):
        ledger.add(push)
    return ledger.report(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def _sql_kind(rank: int, kind: str, pattern: str, fits: str = "true", skip: str = "0") -> str:
    """Spans of a kind: places add up from the pieces between matches; ``skip``: characters before the span that the match takes."""
    p = pattern.replace("'", "''")
    size = "list_sum(list_transform({}, lambda z: length(z)))"
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, s + {skip} AS s, s + length(x) AS e
  FROM (SELECT doc_id, unnest(m) AS x, unnest(list_transform(m, lambda x, i: {size.format("p[1:i]")} + coalesce({size.format("m[1:i - 1]")}, 0)))::BIGINT AS s
        FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS p FROM t WHERE regexp_matches(text, '{p}'))) WHERE {fits}"""


_SQL_ASSIGN = """([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_SQL_JWT = r"(?:^|[^A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
_SQL_KINDS = [
    _sql_kind(0, "assign", _SQL_ASSIGN, "length(regexp_extract(x, '" + _SQL_ASSIGN.replace("'", "''") + "', 2)) >= 12"),
    _sql_kind(1, "access", "AKIA[A-Z0-9]+", "length(x) >= 18"),
    _sql_kind(2, "hex", "[0-9a-f]{16,}"),
    _sql_kind(3, "private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    _sql_kind(4, "jwt", _SQL_JWT, skip="CASE WHEN starts_with(x, 'eyJ') THEN 0 ELSE 1 END"),
    _sql_kind(5, "forge_token", "gh[pousr]_[A-Za-z0-9]{36,}"),
    _sql_kind(6, "chat_token", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    _sql_kind(7, "map_key", "AIza[0-9A-Za-z_-]{35}"),
    _sql_kind(8, "url_login", r"[a-z][a-z0-9+.-]{0,31}://[^\s/:@]+:[^\s/:@]+@[^\s/]+"),
]
#: White space is ASCII here, and a URL's scheme is the longest; texts with others differ in these kinds alone.
ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
every AS ({" UNION ALL ".join(_SQL_KINDS)}),
found AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
  FROM every GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN found USING (doc_id)
"""
