"""Secret scans over many versions of many files, each distinct content scanned once per version of the rules.

A content is known by its SHA-256. The ledger holds which contents were scanned under which version of
the rules, and what was found. A scan takes the contents that the ledger lacks, one row for each, finds
spans with the built-in regular expressions, adds both to the ledger, and joins findings back to every
path that ever had the content. Only DataFrame functions are used.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.session import new_scratch


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    value_group: int = 0  # what must be long enough
    least: int = 1
    base: bool = True


#: A maximal run is found by asking for the least length at once, except where a short match has to use up its text.
RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("hosted", r"gh[pousr]_[A-Za-z0-9]{30,}", base=False),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
)
VERSION = "1"


def _spans(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``digest, rank, kind, start, stop`` of every match; ``blobs`` has ``digest, content``."""
    per_rule = []
    for rank, rule in enumerate(rules):
        matches = F.regexp_extract_all("content", F.lit(rule.pattern), F.lit(0))
        values = F.regexp_extract_all("content", F.lit(rule.pattern), F.lit(rule.value_group)) if rule.value_group else matches
        gaps = F.split("content", rule.pattern, -1)
        rows = F.transform(F.arrays_zip(gaps.alias("gap"), matches.alias("match"), values.alias("value")), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["match"]).alias("size"), F.length(x["value"]).alias("value")))
        own = F.transform(F.slice(rows, 1, F.size(rows) - 1), lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("i"), x["gap"].alias("gap"), x["size"].alias("size"), (x["value"] >= rule.least).alias("good")))
        per_rule.append(F.when(F.col("content").rlike(rule.pattern), own).otherwise(F.array().cast("array<struct<rank:int,i:int,gap:int,size:int,good:boolean>>")))
    rows = blobs.select("digest", F.explode(F.concat(*per_rule)).alias("m")).select("digest", "m.*")
    rows = rows.distinct()  # a path may have the same content in several rows
    upto = Window.partitionBy("digest", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.col("size")).over(upto)
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    found = rows.withColumn("stop", stop).where("good")
    return found.select("digest", "rank", kinds[F.col("rank")].alias("kind"), (F.col("stop") - F.col("size")).alias("start"), "stop")


def _read(spark, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def scan(versions: DataFrame, ledger: str, path: str = "path", content: str = "content", rules: tuple[Rule, ...] = RULES, version: str = VERSION) -> DataFrame:
    """Scan what is new in ``versions``; returns ``digest, rank, kind, start, stop`` for all its contents, from the ledger.

    Null content is empty. Rows may repeat, paths may be null; a content is scanned once all the same.
    """
    spark = versions.sparkSession
    blobs = versions.select(F.col(f"`{path}`").alias("path"), F.coalesce(F.col(f"`{content}`"), F.lit("")).alias("content"))
    blobs = blobs.withColumn("digest", F.sha2("content", 256))
    scanned = _read(spark, f"{ledger}/scanned", "digest string, version string").where(F.col("version") == version)
    first = blobs.groupBy("digest").agg(F.min("path").alias("path"))
    unseen = first.join(scanned, "digest", "left_anti")
    todo = blobs.alias("b").join(unseen.alias("u"), F.expr("b.digest = u.digest and b.path <=> u.path"), "left_semi")
    run = uuid.uuid4().hex
    _spans(todo, rules).distinct().withColumn("version", F.lit(version)).write.parquet(f"{ledger}/findings/run={run}")
    unseen.select("digest", F.lit(version).alias("version")).write.parquet(f"{ledger}/scanned/run={run}")
    found = _read(spark, f"{ledger}/findings", "digest string, rank int, kind string, start long, stop long, version string")
    return found.where(F.col("version") == version).drop("version", "run").distinct()


def report(versions: DataFrame, found: DataFrame, content: str = "content", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``versions`` without ``content``, with counts of the base kinds and the spans of its content."""
    span = F.concat_ws(":", "kind", "start", "stop")
    entry = F.struct("start", "rank", span.alias("span"))
    base = [i for i, r in enumerate(rules) if r.base]
    joined = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["span"]), ",")
    per_blob = found.groupBy("digest").agg(
        *[F.sum((F.col("rank") == i).cast("long")).alias(f"n_{rules[i].kind}") for i in base],
        joined(F.collect_list(F.when(F.col("rank").isin(base), entry))).alias("base"),
        joined(F.collect_list(entry)).alias("spans"),
    )
    counts = [f"n_{rules[i].kind}" for i in base]
    rest = [c for c in versions.columns if c not in (content, *counts, "base_sha256", "spans")]
    rows = versions.select(*[F.col(f"`{c}`") for c in rest], F.sha2(F.coalesce(F.col(f"`{content}`"), F.lit("")), 256).alias("__digest"))
    out = rows.join(per_blob.withColumnRenamed("digest", "__digest"), "__digest", "left")
    return out.select(
        *[F.col(f"`{c}`") for c in rest],
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def find_secrets(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for each row of ``docs``; other columns are not read.

    Spans are in code points, the end exclusive. Null and empty text has none; rows that repeat are all reported.
    """
    docs = docs.select("doc_id", "text")
    found = scan(docs, ledger or new_scratch(docs.sparkSession, "secret-ledger"), "doc_id", "text")
    return report(docs, found, "text")


def masked(docs: DataFrame, ledger: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with every span of a secret replaced by its kind in angle brackets; ``n_chars``, if there, follows.

    Spans that overlap are masked as far as they reach, under the kind of the first. Null text stays null;
    rows without a secret are as they were.
    """
    found = scan(docs, ledger or new_scratch(docs.sparkSession, "secret-ledger"), "doc_id", text)
    before = Window.partitionBy("digest").orderBy("start", "rank", "stop").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("stop").over(before), F.lit(0))
    apart = found.withColumn("reached", reached).where("stop > reached").withColumn("from", F.greatest("start", "reached"))
    spans = apart.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("from", "stop", "start", "kind"))).alias("__spans"))
    end = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("__spans", i - 1)["stop"])
    body = F.col("__content")
    gap = lambda x, i: F.substring(body, end(i).cast("int") + 1, (x["from"] - end(i)).cast("int"))
    mark = lambda x: F.when(x["from"] == x["start"], F.concat(F.lit("<"), x["kind"], F.lit(">"))).otherwise(F.lit(""))
    pieces = F.transform("__spans", lambda x, i: F.concat(gap(x, i), mark(x)))
    rest = F.substring(body, F.element_at("__spans", -1)["stop"].cast("int") + 1, F.length(body))
    rows = docs.withColumn("__content", F.coalesce(F.col(text), F.lit("")))
    rows = rows.withColumn("__digest", F.sha2("__content", 256)).join(spans.withColumnRenamed("digest", "__digest"), "__digest", "left")
    hit = F.col("__spans").isNotNull()
    clean = F.when(hit, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col(text))
    rows = rows.withColumn("__clean", clean)
    told = {text: F.col("__clean")}
    if "n_chars" in docs.columns:
        told["n_chars"] = F.when(hit, F.length("__clean")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[told[c].alias(c) if c in told else F.col(f"`{c}`") for c in docs.columns])


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts = [
        f"select r, {i} as rank, {quoted(x.kind)} as kind, {str(x.base).lower()} as base, {x.least} as least, string_split_regex(t, {quoted(x.pattern)}) as gaps, "
        f"regexp_extract_all(t, {quoted(x.pattern)}) as ms, regexp_extract_all(t, {quoted(x.pattern)}, {x.value_group}) as vs from d where regexp_matches(t, {quoted(x.pattern)})"
        for i, x in enumerate(RULES)
    ]
    return f"""
with d as materialized (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
m as materialized ({' union all '.join(parts)}),
e as (select r, rank, kind, base, least, unnest(range(1, len(ms) + 1)) as i, gaps, ms, vs from m),
s as (
  select r, rank, kind, base, length(vs[i]) >= least as good, length(ms[i]) as size,
    sum(length(gaps[i]) + length(ms[i])) over (partition by r, rank order by i) as stop from e),
f as (select r, rank, base, stop - size as start, kind || ':' || (stop - size)::varchar || ':' || stop::varchar as span from s where good),
g as (
  select r, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex,
    string_agg(span, ',' order by start, rank) filter (base) as base, string_agg(span, ',' order by start, rank) as spans
  from f group by r)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g using (r)
"""


QUERIES = {"op5_secrets": op5_secrets}
ORACLE = {"op5_secrets": _oracle()}
