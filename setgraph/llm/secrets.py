"""Secret scans by an incremental ledger of blobs.

Every version of a text is a blob named by the SHA-256 of its bytes. The ledger holds the (blob, rule version) pairs
that have been scanned and what was found; a scan reads only pairs that the ledger lacks, once for each distinct
blob, and the findings are joined back to all paths that hold the blob. Everything is DataFrame functions.

Null texts count as empty, and an empty text has no findings. Repeated rows and rows with null ids each get the
findings of their blob. Spans are code points, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut_lineage
from .common import table, text_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, and the least length of one of its groups; shorter matches are dropped."""

    kind: str
    pattern: str
    group: int
    least: int
    base: bool = True


# The base kinds in their order, then what this scan adds.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, base=False),
)
#: To be raised with every change of RULES: blobs are then scanned again under the new version.
RULE_VERSION = "2"

#: Cheap tests that every text with a match of the rule passes.
_HINTS = {"assign": "(?i)(?:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]", "access": "AKIA", "hex": "[0-9a-f]{32}", "pem": "-----BEGIN "}

LEDGER_SCHEMA = "blob string, rule_version string, found array<struct<start:int,kind_at:int,kind:string,end:int>>"


def _spans(text: Column, at: int, rule: Rule) -> Column:
    """Spans of the leftmost, non-overlapping matches of a rule.

    The pieces between matches and the matches alternate, so running sums of their lengths give the offsets.
    """
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    tested = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else whole
    parts = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("size"), tested.alias("tested"))
    summed = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind_at:int,kind:string,end:int>>").alias("spans")),
        lambda done, part: F.struct(
            (done["at"] + part["gap"] + part["size"]).alias("at"),
            F.when(
                part["tested"] >= rule.least,
                F.concat(
                    done["spans"],
                    F.array(
                        F.struct(
                            (done["at"] + part["gap"]).alias("start"),
                            F.lit(at).alias("kind_at"),
                            F.lit(rule.kind).alias("kind"),
                            (done["at"] + part["gap"] + part["size"]).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(done["spans"])
            .alias("spans"),
        ),
        lambda done: done["spans"],
    )
    none = F.array().cast("array<struct<start:int,kind_at:int,kind:string,end:int>>")
    return F.when(text.rlike(_HINTS[rule.kind]), summed).otherwise(none)


def find_secrets(text: Column) -> Column:
    """All spans of a text as structs (start, kind_at, kind, end), sorted by start and kind."""
    return F.array_sort(F.concat(*(_spans(text, at, rule) for at, rule in enumerate(RULES))))


def scan_unseen(blobs: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """New rows of the ledger (LEDGER_SCHEMA) for the rows (blob, text) whose pair with rule_version it lacks.

    Each distinct blob is scanned once. Copies meet by partial aggregation, so one text with a third of all rows
    makes one row a task before the shuffle.
    """
    if ledger is not None:
        seen = ledger.filter(F.col("rule_version") == rule_version).select("blob").distinct()
        blobs = blobs.join(seen, "blob", "left_anti")
    once = blobs.groupBy("blob").agg(F.any_value("text").alias("text"))
    return once.select("blob", F.lit(rule_version).alias("rule_version"), find_secrets(F.col("text")).alias("found"))


def with_blob(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the content address of its text in column blob."""
    return docs.withColumn("blob", F.sha2(text_of(text), 256))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """Findings of every row of docs (doc_id, blob, found), and the ledger's new rows.

    Append the new rows to the ledger's table before the next scan; texts met again are then not read by a pattern.
    """
    keyed = with_blob(docs.select("doc_id", text_of().alias("text")))
    # Written before it is joined: the findings of each blob are few, and a blob with many paths can then be split.
    new = cut_lineage(scan_unseen(keyed.select("blob", "text"), ledger, rule_version))
    known = new
    if ledger is not None:
        old = ledger.filter(F.col("rule_version") == rule_version).groupBy("blob", "rule_version").agg(F.any_value("found").alias("found"))
        known = old.unionByName(new)
    # Most texts hold nothing: only blobs with findings meet the paths.
    hits = known.filter(F.size("found") > 0).select("blob", "found")
    return keyed.select("doc_id", "blob").join(hits, "blob", "left"), new


def _digest(found: Column, base_only: bool) -> Column:
    kept = F.filter(found, lambda s: s["kind_at"] < sum(r.base for r in RULES)) if base_only else found
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def findings_digest(found: DataFrame) -> DataFrame:
    """doc_id, counts and joined spans for rows of (doc_id, blob, found)."""
    spans = F.coalesce(F.col("found"), F.array().cast(found.schema["found"].dataType))

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *(count(r.kind).alias(f"n_{r.kind}") for r in RULES),
        F.sha2(_digest(spans, base_only=True), 256).alias("base_sha256"),
        _digest(spans, base_only=False).alias("spans"),
    )


def redact(text: Column, found: Column) -> Column:
    """The text with every span of found replaced by [SECRET]; overlapping spans make one replacement."""
    out = F.aggregate(
        found,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda done, s: F.struct(
            F.greatest(done["at"], s["end"]).alias("at"),
            F.when(s["start"] < done["at"], done["out"]).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, s["start"] - done["at"]), F.lit("[SECRET]"))).alias("out"),
        ),
        lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.lit(2**31 - 1))),
    )
    return F.when(F.size(found) > 0, out).otherwise(text)


def redacted(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """docs with every secret of their texts replaced and n_chars, where there is one, counted anew."""
    keyed = with_blob(docs.withColumn("text", F.col("text").cast("string")))
    new = scan_unseen(keyed.select("blob", text_of().alias("text")), ledger)
    known = new if ledger is None else ledger.filter(F.col("rule_version") == RULE_VERSION).unionByName(new)
    hits = known.filter(F.size("found") > 0).groupBy("blob").agg(F.any_value("found").alias("_found"))
    out = keyed.join(cut_lineage(hits), "blob", "left")
    has = F.coalesce(F.size("_found") > 0, F.lit(False))
    clean = F.when(has, redact(F.col("text"), F.col("_found"))).otherwise(F.col("text"))
    out = out.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(has, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op1_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, scanned once for each distinct text."""
    found, _ = scan(table(spark, sf_dir, "documents"))
    return findings_digest(found)


def _oracle() -> str:
    """The same in DuckDB."""

    def spans(at: int, rule: Rule) -> str:
        pattern = rule.pattern.replace("'", "''").replace(r"\x20", " ")
        gaps = f"list_transform(string_split_regex(t, '{pattern}'), lambda x: length(x))"
        whole = f"list_transform(regexp_extract_all(t, '{pattern}', 0), lambda x: length(x))"
        tested = f"list_transform(regexp_extract_all(t, '{pattern}', {rule.group}), lambda x: length(x))"
        start = "coalesce(list_sum(g[1:i]), 0)::BIGINT + coalesce(list_sum(m[1:i-1]), 0)::BIGINT"
        return f"""SELECT row_at, {at} AS kind_at, '{rule.kind}' AS kind, {start} AS s, {start} + m[i] AS e FROM (
            SELECT row_at, g, m, k, unnest(range(1, len(m) + 1)) AS i FROM (
                SELECT row_at, {gaps} AS g, {whole} AS m, {tested} AS k FROM docs)) WHERE k[i] >= {rule.least}"""

    every = " UNION ALL ".join(spans(at, rule) for at, rule in enumerate(RULES))
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}')::BIGINT AS n_{r.kind}" for r in RULES)
    n_base = sum(r.base for r in RULES)
    zero = ", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in RULES)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row_at, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({every}),
each AS (SELECT row_at, {counts},
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_at) FILTER (kind_at < {n_base}) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_at) AS every_span
    FROM found GROUP BY row_at)
SELECT doc_id, {zero}, sha256(coalesce(base, '')) AS base_sha256, coalesce(every_span, '') AS spans
FROM docs LEFT JOIN each USING (row_at)"""


ORACLE = _oracle()
