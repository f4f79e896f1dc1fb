"""Structured feeds in captured bodies: embedded JSON, maps of values, result pages, sparse records and pinned files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import is_known
from quarry.functions.urls import decoded


def embedded_json(body: Column, marker: str) -> Column:
    """The JSON text that a page assigns after a marker, up to the end of its script; null without one."""
    found = F.regexp_extract(F.coalesce(body, F.lit("")), rf"(?s){marker}\s*=\s*(\{{.*?\}})\s*;?\s*(?:</script>|$)", 1)
    return F.nullif(found, F.lit(""))


def map_entries(rows: DataFrame, key: str, json: Column, kind: str) -> DataFrame:
    """(key, name, value) of a JSON object's members, value in a given type; members that do not fit it are null."""
    return rows.select(key, F.explode(F.from_json(json, f"map<string,{kind}>")).alias("name", "value"))


def ratings(rows: DataFrame, score: str = "score", count: str = "reviews", scale: int = 5) -> DataFrame:
    """Ratings as they may be shown: scores out of range or without reviews are null, with the state that says so."""
    good = F.col(score).between(1, scale) & (F.col(count) > 0)
    status = F.when(F.coalesce(F.col(count) == 0, F.lit(False)), "no_reviews").when(good, "verified").otherwise("unavailable")
    return rows.withColumns({"status": status, score: F.when(good, F.col(score)), "scale": F.lit(scale)})


def unwrapped_results(link: Column, parameter: str = "uddg") -> Column:
    """The target inside a search engine's redirecting link; other links as they are."""
    inner = F.regexp_extract(link, rf"[?&]{parameter}=([^&]*)", 1)
    return F.when(inner != "", decoded(inner)).otherwise(link)


def sparse(df: DataFrame, keep: list[str]) -> DataFrame:
    """One JSON text a record with the fields to keep; missing values, sentinels and empty lists are left out."""
    fields = []
    for f in df.select(*keep).schema:
        value = F.col(f"`{f.name}`")
        kind = f.dataType.simpleString()
        fields.append(F.when(F.size(value) > 0, value).alias(f.name) if kind.startswith("array") else F.when(is_known(value), value).alias(f.name) if kind == "string" else value.alias(f.name))
    return df.select(F.to_json(F.struct(*fields)).alias("value"))


def pinned(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """A file's text if its hash is the pinned one; the job fails otherwise."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    ok = F.sha2("content", 256) == sha256
    return files.select("path", F.when(ok, F.decode("content", "UTF-8")).otherwise(F.raise_error(F.concat(F.lit("the file is not the one that was audited: "), F.col("path")))).alias("body"))


def of_source(records: DataFrame, sources: str, source: str) -> DataFrame:
    """Records that a source listed."""
    return records.where(F.array_contains(F.col(sources), source))


def not_discovered(records: DataFrame, sources: str, marks: list[str]) -> DataFrame:
    """Records that some source beside the automatic ones listed."""
    return records.where(F.size(F.array_except(F.col(sources), F.array(*map(F.lit, marks)))) > 0)


def flattened(rows: DataFrame, key: str, nested: str, inner: str) -> DataFrame:
    """Groups of groups as rows: key, the fields of each nested struct but its inner list, and the inner structs' fields; empty inner lists keep their group."""
    outer = rows.select(key, F.explode(nested).alias("g"))
    return outer.select(key, F.col("g").dropFields(inner).alias("group"), F.explode_outer(F.col("g")[inner]).alias("item"))


def robots_for(text: DataFrame, host: str, body: str, agent: str) -> DataFrame:
    """(host, n, rule, path): the agent's own groups where a body has any, else those for all."""
    from quarry.sources.captures import robots_rules

    own = robots_rules(text, host, body, agent)
    named = text.select(host).join(own.select(host).distinct(), host, "left_anti").select(host).distinct()
    rest = robots_rules(text.join(named, host, "left_semi"), host, body, "*")
    return own.unionByName(rest)


def robots_allow(rules: DataFrame, requests: DataFrame, host: str, path: str, key: str) -> DataFrame:
    """(key, allowed): the longest rule that a path begins with decides, allowing ones first; '*' stands for anything and '$' for the end."""
    pattern = F.concat(F.lit("^"), F.replace(F.replace(F.regexp_replace(F.col("rule_path"), r"([.?+(){}\[\]\\^|])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit("$"), F.lit("$")))
    own = rules.where(F.col("rule").isin("allow", "disallow") & (F.col("path") != "")).select(F.col(host).alias("_h"), "rule", F.col("path").alias("rule_path"))
    met = requests.select(key, F.col(host).alias("_r"), F.col(path).alias("asked")).join(own, F.col("_r") == F.col("_h"), "left")
    fits = F.coalesce(F.regexp_like("asked", pattern), F.lit(False))
    best = F.max_by("rule", F.when(fits, F.struct(F.length("rule_path"), (F.col("rule") == "allow").cast("int"))))
    return met.groupBy(key).agg(best.alias("rule")).select(key, F.coalesce(F.col("rule") == "allow", F.lit(True)).alias("allowed"))
