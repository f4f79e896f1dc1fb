"""Reading and writing: JSON, JSON lines, CSV, text and HTML captures in; tables, JSON lines and Markdown out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

SENTINELS = ("", "Not found", "Unknown")


def sentinels_to_null(df: DataFrame) -> DataFrame:
    """Missing values are null inside the engine."""
    return df.withColumns({f.name: F.when(~F.col(f"`{f.name}`").isin(*SENTINELS), F.col(f"`{f.name}`")) for f in df.schema if isinstance(f.dataType, StringType)})


def sentinels_back(df: DataFrame, by: dict[str, str]) -> DataFrame:
    """The sentinel of each column that is to be exported with one."""
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(s)) for c, s in by.items()})


def read_json(spark: SparkSession, path: str, schema: StructType, lines: bool = False) -> DataFrame:
    """A JSON document or JSON lines with a given schema; what does not parse stands in _corrupt and is never dropped."""
    with_corrupt = StructType([*schema.fields]).add("_corrupt", "string")
    return spark.read.schema(with_corrupt).option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page bodies as files: path, body (text), bytes and sha256."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("body"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def robots_rules(text: DataFrame, host: str, body: str, agent: str = "*") -> DataFrame:
    """(host, rule, path) of the agent's groups of robots.txt bodies, in order."""
    lines = F.transform(F.split(F.col(body), r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))
    each = text.select(host, F.posexplode(lines).alias("n", "line")).where("line <> ''")
    key, value = F.lower(F.trim(F.regexp_extract("line", r"^([^:]*):", 1))), F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))
    each = each.select(host, "n", key.alias("rule"), value.alias("path"))
    # runs of user-agent lines begin a group; within one body the window is as long as the file
    from pyspark.sql import Window

    order = Window.partitionBy(host).orderBy("n")
    is_agent = F.col("rule") == "user-agent"
    begins = is_agent & ~F.coalesce(F.lag(is_agent).over(order), F.lit(False))
    grouped = each.withColumn("g", F.sum(begins.cast("int")).over(order))
    mine = grouped.where(is_agent & (F.lower("path") == agent.lower())).select(host, "g").distinct()
    return grouped.join(mine, [host, "g"]).where(F.col("rule").isin("allow", "disallow", "crawl-delay")).select(host, "n", "rule", "path")


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines; the committer puts whole files into place."""
    df.write.mode("overwrite").json(path)


def write_markdown(df: DataFrame, path: str) -> None:
    """A report as one Markdown table with its header. For reports, which are small: it is one file, written by one task."""
    cells = [F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in df.columns]
    rows = df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
    head = [f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}"]
    df.sparkSession.createDataFrame([(h,) for h in head], "value string").coalesce(1).unionByName(rows.coalesce(1)).coalesce(1).write.mode("overwrite").text(path)


def vcards(rows: DataFrame, key: str, body: str) -> DataFrame:
    """(key, position, name, email, url, title) of each vCard in a text."""
    unfolded = F.regexp_replace(F.coalesce(F.col(body), F.lit("")), r"\r?\n[ \t]", "")
    cards = F.regexp_extract_all(unfolded, F.lit(r"(?is)BEGIN:VCARD(.*?)END:VCARD"), F.lit(1))
    each = rows.select(key, F.posexplode(cards).alias("position", "card"))
    part = lambda p: F.nullif(F.trim(F.regexp_extract("card", rf"(?im)^{p}(?:;[^:\r\n]*)?:(.*?)\r?$", 1)), F.lit(""))
    return each.select(key, "position", part("FN").alias("name"), F.lower(part("EMAIL")).alias("email"), part("URL").alias("url"), part("TITLE").alias("title"))
