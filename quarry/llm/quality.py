"""Host-level quality rules, in DataFrame functions only.

Every document is measured once. The documents that fail each rule (few words, repeated windows, symbols, repeated lines) are summed
by host with a partial aggregation, each host's rate of failure by each rule is shrunk towards a beta prior fitted to all hosts by
moments, and the host's verdict is joined back: a host is rejected where it fails a rule more often than not. The first two rules
also reject a document by itself.

Defined results: a null text has no words and fails; a null host has no verdict, so only the document's own rules
count; repeated rows are measured and counted one by one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SPACE, pack, without, words
from quarry.plans.shared import shared_table

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
RULES = ("few_words", "repeats", "symbols", "dup_lines")


def measured(docs: DataFrame, min_words: int = 10, repeat_percent: int = 20, symbol_percent: int = 10, line_percent: int = 30) -> DataFrame:
    """docs has _text; adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fails (struct of RULES) and base_failed."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    has_word = f"[^{SPACE}]"
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(has_word))
    out = docs.withColumns(
        {
            "_h": F.transform(words(F.col("_text")), lambda w: F.xxhash64(w)),
            "_lines": lines,
            "word_chars": F.char_length(without(text, SPACE)).cast("long"),
            "n_symbols": (F.octet_length(text) - F.octet_length(without(text, SYMBOLS))).cast("long"),
        }
    )
    n = F.size("_h")
    out = out.withColumns(
        {
            "n_words": n.cast("long"),
            "_n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_w": F.expr(
                f"transform(slice(_h, 1, greatest(size(_h) - {WINDOW - 1}, 0)), (h, i) -> xxhash64(h, "
                + ", ".join(f"_h[i + {k}]" for k in range(1, WINDOW))
                + "))"
            ),
        }
    ).drop("_lines")
    out = out.withColumn("_s", F.expr("case when size(array_distinct(_w)) < size(_w) then sort_array(transform(_w, (h, i) -> struct(h, i))) end"))
    out = out.withColumn(
        "_p",
        F.expr("sort_array(filter(transform(_s, (s, j) -> case when s.h = get(_s, j - 1).h or s.h = get(_s, j + 1).h then s.i end), x -> x is not null))"),
    )
    out = out.withColumn(
        "n_repeat_words",
        F.expr(
            f"coalesce(aggregate(_p, struct(-{WINDOW} as last, 0L as n), (a, p) -> struct(p as last, a.n + least({WINDOW}, p - a.last) as n), a -> a.n), 0L)"
        ),
    )
    fails = F.struct(
        (F.col("n_words") < min_words).alias("few_words"), (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words")).alias("repeats"),
        (100 * F.col("n_symbols") > symbol_percent * F.col("word_chars")).alias("symbols"), (100 * F.col("n_dup_lines") > line_percent * F.col("_n_lines")).alias("dup_lines"),
    )
    out = out.withColumn("fails", fails).withColumn("base_failed", F.col("fails.few_words") | F.col("fails.repeats"))
    return out.drop("_h", "_w", "_s", "_p", "_n_lines")


def host_verdicts(scored: DataFrame, max_rate: float = 0.5, default_strength: float = 10.0) -> DataFrame:
    """scored has _host, fails and base_failed; one row per host that is not null, with a posterior rate for each rule.

    The prior of a rule is Beta(m k, (1 - m) k), m the mean of the hosts' failure rates and k = m (1 - m) / v - 1, v their
    variance; default_strength stands for k where v is zero or leaves k not positive. A host is rejected if its
    posterior mean rate is over max_rate by any rule.
    """
    counts = [F.count_if(f"fails.{r}").alias(r) for r in RULES]
    hosts = scored.where(F.col("_host").isNotNull()).groupBy("_host").agg(F.count("*").alias("host_docs"), F.count_if("base_failed").alias("host_failed"), *counts)
    moments = hosts.agg(*[f(F.col(r) / F.col("host_docs")).alias(f"{n}_{r}") for r in RULES for n, f in (("m", F.avg), ("v", F.var_pop))])
    priors = []
    for r in RULES:
        m = F.col(f"m_{r}")
        k = m * (1 - m) / F.nullif(F.col(f"v_{r}"), F.lit(0.0)) - 1
        priors.append(F.struct(m.alias("m"), F.when(k > 0, k).otherwise(F.lit(default_strength)).alias("k")).alias(r))
    prior = moments.select(F.struct(*priors)).scalar()
    shrunk = lambda r: (F.col(r) + prior[r]["m"] * prior[r]["k"]) / (F.col("host_docs") + prior[r]["k"])
    rates = F.struct(*[shrunk(r).alias(r) for r in RULES])
    rated = hosts.select("_host", "host_docs", "host_failed", rates.alias("host_rates"))
    return rated.withColumn("host_rejected", F.greatest(*[F.col(f"host_rates.{r}") for r in RULES]) > max_rate)


def quality_rules(
    docs: DataFrame, text: str = "text", host: str = "source", keep_rows: bool = True,
    min_words: int = 10, repeat_percent: int = 20, max_rate: float = 0.5, default_strength: float = 10.0,
) -> DataFrame:
    """Returns _row (the row of docs; its text left out unless keep_rows), the measures, host counts and kept.

    The measured rows are written once as a shared table, since the hosts' sums and the result both read them.
    The verdicts are written too and join on the host without a hint: their size is known, so that Spark broadcasts them below
    its size threshold without a shuffle, and beyond it splits a hot host's rows in a merge join of two written sides.
    """
    rows = pack(docs, _text=text, _host=host)
    if not keep_rows:
        rows = rows.withColumn("_row", F.col("_row").dropFields(text))
    scored = shared_table(measured(rows, min_words, repeat_percent).drop("_text"))
    verdicts = shared_table(host_verdicts(scored, max_rate, default_strength))
    joined = scored.join(verdicts, "_host", "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("host_rejected"), F.lit(False)))
