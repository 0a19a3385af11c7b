"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every distinct text is a blob, addressed by its SHA-256. The ledger records which (blob, rule) pairs
have been scanned and the spans found; a scan reads one document for each blob that some rule has not
seen, with those rules alone, and joins the spans back to every document that holds the blob. A rule's name
carries its version, so a changed rule is a new pair for every blob.

Offsets are code points, ends exclusive. A rule keeps the leftmost non-overlapping matches of its
pattern and then drops those whose measured group is too short. Positions come from the running length
of the gaps between matches (`split`) and of the matches (`regexp_extract_all`), one row a match, so
work is linear in the text and in its matches.

Defined results: null text counts as empty and has no spans; repeated rows are answered one by one, with
or without doc_id; spans order by start, then by the rule's place in the list, then by end. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, salted_join


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int
    least: int
    base: bool = True
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


def either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isascii() and c.isalpha() else c for c in words)


# fixed values: the kinds and patterns that the contract lists, in its order; then those added here
RULES = (
    Rule("assign", "(" + either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27, False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, False),
)
_MATCH = "array<struct<gap:string,hit:string,part:string>>"


def blobs(docs: DataFrame) -> DataFrame:
    """doc_id, text (never null) and the text's address."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))


def _matches(text: str, rule: Rule):
    gaps = F.split(text, rule.pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else hits
    found = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"), parts.alias("part"))
    # the measured group must be long enough somewhere: a cheap test before matches are laid out
    long_enough = rule.pattern if rule.group == 0 else rule.pattern[:-1].removesuffix("+") + "{%d,})" % rule.least
    return F.when(F.col(text).rlike(long_enough), found).otherwise(F.array().cast(_MATCH)).cast(_MATCH)


def scan_blobs(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, rule, kind, place, start, end: a row for each span of each distinct blob of texts (blob, text, unseen:
    the rules, by key, that are to look at it; no other rule does)."""
    own = lambda r: F.when(F.array_contains("unseen", r.key), _matches("text", r)).otherwise(F.array().cast(_MATCH))
    one = lambda i, r: F.struct(F.lit(r.key).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(i).alias("place"), F.lit(r.least).alias("least"), own(r).alias("found"))
    laid = texts.select("blob", F.explode(F.array(*[one(i, r) for i, r in enumerate(rules)])).alias("x")).where("size(x.found) > 0")
    rows = laid.select("blob", "x.rule", "x.kind", "x.place", "x.least", F.posexplode("x.found").alias("nth", "m")).dropDuplicates(["blob", "rule", "nth"])
    so_far = Window.partitionBy("blob", "rule").orderBy("nth")
    end = F.sum(F.length("m.gap") + F.length("m.hit")).over(so_far)
    rows = rows.select("blob", "rule", "kind", "place", end.cast("long").alias("end"), F.length("m.hit").alias("n"), (F.length("m.part") >= F.col("least")).alias("kept"))
    return rows.where("kept").select("blob", "rule", "kind", "place", (F.col("end") - F.col("n")).alias("start"), "end")


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Findings by document and the ledger with this scan's pairs added.

    The ledger has a row for each scanned (blob, rule), with `spans`, an array of (place, kind, start,
    end). Findings: doc_id, blob, spans in order, over all rules given. Write the ledger returned to keep it."""
    held = blobs(docs)
    keys = F.array(*[F.lit(r.key) for r in rules])
    first = held.groupBy("blob").agg(F.min("doc_id").alias("doc_id")).withColumn("unseen", keys)
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        first = first.join(seen, "blob", "left").withColumn("unseen", F.array_except("unseen", F.coalesce("seen", F.array().cast("array<string>")))).drop("seen").where("size(unseen) > 0")
    pairs = first.select("blob", F.explode("unseen").alias("rule"))
    # doc_id spreads evenly where blob alone would not; a blob that only rows without doc_id hold is found by the null
    named = first.select(F.col("blob").alias("first_blob"), F.col("doc_id").alias("first_id"), "unseen")
    texts = held.join(named, (F.col("blob") == F.col("first_blob")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).select("blob", "text", "unseen")
    spans = scan_blobs(texts, rules)
    found = cut(spans.groupBy("blob", "rule").agg(F.array_sort(F.collect_list(F.struct("start", "place", "end", "kind"))).alias("spans")))
    none = F.array().cast("array<struct<start:bigint,place:int,end:bigint,kind:string>>")
    added = pairs.join(found, ["blob", "rule"], "left").withColumn("spans", F.coalesce("spans", none))
    whole = added if ledger is None else ledger.select("blob", "rule", "spans").unionByName(added)
    known = found if ledger is None else found.unionByName(ledger.where(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0)).select("blob", "rule", "spans"))
    by_blob = known.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    findings = salted_join(held.select("doc_id", "blob"), by_blob, "blob", "doc_id", "left").withColumn("spans", F.coalesce("spans", none))
    return findings, whole


def digest(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    base = [r.kind for r in rules if r.base]
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    only = F.filter("spans", lambda x: x["kind"].isin(base))
    return findings.select("doc_id", *[count(k) for k in base], F.sha2(text(only), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, findings: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every span's characters replaced by one mark; overlapping spans merge into one."""
    merged = F.aggregate(
        F.col("spans"),
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda a, x: F.when(
            (F.size(a) > 0) & (x["start"] < F.element_at(a, -1)["end"]),
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(a, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))),
    )
    hit = findings.where(F.size("spans") > 0).select(F.col("blob").alias("_blob"), merged.alias("_merged")).dropDuplicates(["_blob"])
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("_merged", lambda x: x["end"]))
    starts = F.concat(F.transform("_merged", lambda x: x["start"]), F.array(F.length("text").cast("bigint")))
    kept = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda x: F.substring(F.col("text"), (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")))
    joined = salted_join(docs.withColumn("_blob", F.sha2(F.coalesce("text", F.lit("")), 256)), hit, "_blob", "doc_id", "left")
    return joined.withColumn("text", F.when(F.col("_merged").isNull(), F.col("text")).otherwise(F.array_join(kept, mark))).select(*docs.columns)


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The contract's rows in DuckDB SQL."""

    def one(i: int, r: Rule) -> str:
        q = r.pattern.replace("'", "''")
        return f"""SELECT blob, {i} AS place, '{r.kind}' AS kind, hits[j] AS hit, parts[j] AS part, {r.least} AS least,
          list_sum(list_transform(gaps[1:j], lambda x: length(x))) + COALESCE(list_sum(list_transform(hits[1:j - 1], lambda x: length(x))), 0) AS start
        FROM (SELECT blob, gaps, hits, parts, unnest(range(1, len(hits) + 1)) AS j FROM (
          SELECT blob, regexp_split_to_array(text, '{q}') AS gaps, regexp_extract_all(text, '{q}') AS hits, regexp_extract_all(text, '{q}', {r.group}) AS parts FROM b))"""

    every = " UNION ALL ".join(one(i, r) for i, r in enumerate(rules))
    base = ", ".join(f"'{r.kind}'" for r in rules if r.base)
    say = "string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + length(hit) AS BIGINT), ',' ORDER BY start, place, start + length(hit))"
    counts = ", ".join(f"CAST(COALESCE(n_{r.kind}, 0) AS BIGINT) AS n_{r.kind}" for r in rules if r.base)
    sums = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in rules if r.base)
    return f"""WITH d AS (SELECT doc_id, sha256(COALESCE(text, '')) AS blob FROM documents),
    b AS (SELECT DISTINCT sha256(COALESCE(text, '')) AS blob, COALESCE(text, '') AS text FROM documents),
    s AS (SELECT * FROM ({every}) WHERE length(part) >= least),
    g AS (SELECT blob, {sums}, {say} FILTER (kind IN ({base})) AS base, {say} AS spans FROM s GROUP BY blob)
    SELECT d.doc_id, {counts}, sha256(COALESCE(base, '')) AS base_sha256, COALESCE(spans, '') AS spans FROM d LEFT JOIN g USING (blob)"""


__all__ = ["RULES", "Rule", "blobs", "digest", "oracle", "redact", "scan", "scan_blobs"]
