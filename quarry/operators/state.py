"""What a reader asks for: filters, orders and pages as columns, and their form in a URL's query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.urls import decoded

# Names of the filters in a URL, their defaults, kinds of evidence and orders.
PARAMETERS = {
    "query": "q", "type": "type", "division": "school", "department": "dept", "field": "field", "area": "area", "recruiting": "status", "evidence": "evidence", "verified_only": "checked",
    "saved_only": "saved", "sort": "sort",
}
DEFAULTS = {k: "" if k == "query" else "relevance" if k == "sort" else "all" for k in PARAMETERS} | {"verified_only": False, "saved_only": False}
EVIDENCE = ("courses", "ratings", "rateMyPI", "rateMyProfessors", "needs_review")
ORDERS = ("relevance", "name", "department", "courses", "rating", "citations", "sources")


def evidence_keys(evidence: Column) -> Column:
    """Known kinds of evidence of a list separated by commas, in a fixed order; 'all' asks for none."""
    asked = F.split(F.coalesce(evidence, F.lit("")), ",")
    return F.filter(F.array(*map(F.lit, EVIDENCE)), lambda k: F.array_contains(asked, k))


def evidence_text(keys: Column) -> Column:
    return F.when(F.size(keys) > 0, F.array_join(keys, ",")).otherwise("all")


def read_url(query: Column, types: tuple[str, ...]) -> Column:
    """struct of the filters that a URL's query names; unknown types, orders and kinds of evidence fall back."""
    query = F.concat(F.lit("&"), F.regexp_replace(F.coalesce(query, F.lit("")), r"^\?", ""))
    fields = {}
    for key, name in PARAMETERS.items():
        raw = F.regexp_extract(query, f"&{name}=([^&]*)", 1)
        value = F.when(query.rlike(f"&{name}(?:=|&|$)"), decoded(F.replace(raw, F.lit("+"), F.lit(" "))))
        fields[key] = F.coalesce(value == "1", F.lit(False)) if isinstance(DEFAULTS[key], bool) else F.coalesce(value, F.lit(DEFAULTS[key]))
    fields["type"] = F.when(fields["type"].isin("all", *types), fields["type"]).otherwise("all")
    fields["sort"] = F.when(fields["sort"].isin(*ORDERS), fields["sort"]).otherwise("relevance")
    fields["evidence"] = F.when(fields["evidence"] == "all", "all").otherwise(evidence_text(evidence_keys(fields["evidence"])))
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def write_url(state: Column) -> Column:
    """The query of a state: what differs from the defaults, in a fixed order; empty for none."""
    parts = []
    for key, name in PARAMETERS.items():
        value = state[key]
        if isinstance(DEFAULTS[key], bool):
            parts.append(F.when(value, f"{name}=1"))
        else:
            parts.append(F.when((value != DEFAULTS[key]) & (value != ""), F.concat(F.lit(f"{name}="), F.url_encode(value))))
    query = F.array_join(F.array_compact(F.array(*parts)), "&")
    return F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")


def has_evidence(courses: Column, ratings: Column, checked: Column, needs_review: Column, key: Column) -> Column:
    """Whether a record has a kind of evidence; other kinds are platforms among its ratings."""
    return (
        F.when(key == "courses", courses > 0).when(key == "ratings", F.size(ratings) > 0).when(key == "needs_review", ~checked | needs_review).otherwise(F.array_contains(ratings, key))
    )


def matches(records: DataFrame, state: dict[str, object], saved: Column) -> DataFrame:
    """Records (recruiting, courses, ratings, checked, needs_review) that pass all filters of a state."""
    c = F.col
    keep = F.lit(True)
    if state.get("saved_only"):
        keep = keep & saved
    if state.get("recruiting", "all") != "all":
        keep = keep & (F.coalesce("recruiting", F.lit("Unknown")) == state["recruiting"])
    if state.get("verified_only"):
        keep = keep & c("checked")
    for key in [k for k in EVIDENCE if k in str(state.get("evidence", "all")).split(",")]:
        keep = keep & has_evidence(c("courses"), c("ratings"), c("checked"), c("needs_review"), F.lit(key))
    return records.where(keep)


def rating_value(score: Column, count: Column) -> Column:
    return F.when(score.isNotNull(), score * 1000 + F.least(count, F.lit(999))).otherwise(-1)


def order_by(sort: str) -> list[Column]:
    """The columns of an order over name, score, department, courses, rating_score, rating_count, citations and sources; ties by name."""
    name = F.col("name").asc()
    first = {
        "relevance": [F.desc("score")], "name": [], "department": [F.coalesce("department", F.lit("")).asc()], "courses": [F.desc("courses")],
        "rating": [rating_value(F.col("rating_score"), F.col("rating_count")).desc()], "citations": [F.desc("citations")], "sources": [F.desc("sources")],
    }
    return [*first[sort], name]


def narrowed(state: Column, key: str, value: Column) -> Column:
    """A state after a choice: a division clears its department, a field clears its area, a department brings its division, an area its field.

    state has division, department, field, area; value is the choice, or for a department or area struct(own, parent).
    """
    if key == "division":
        return state.withField("division", value).withField("department", F.lit("all"))
    if key == "field":
        return state.withField("field", value).withField("area", F.lit("all"))
    parent = {"department": "division", "area": "field"}[key]
    chosen = value["own"] != "all"
    return state.withField(key, value["own"]).withField(parent, F.when(chosen, value["parent"]).otherwise(state[parent]))


def normalized(state: Column, departments: DataFrame | None = None, known_departments: dict[str, str] | None = None, known_areas: dict[str, str] | None = None) -> Column:
    """A state in which departments and areas are known and lie in the chosen division and field; what does not fit becomes 'all'."""
    lookup = lambda known, key: F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), key) if known else F.lit(None).cast("string")
    for key, parent, known in (("department", "division", known_departments or {}), ("area", "field", known_areas or {})):
        owner = lookup(known, state[key])
        fits = owner.isNotNull() & ((state[parent] == "all") | (state[parent] == owner))
        state = state.withField(key, F.when(fits, state[key]).otherwise("all")).withField(parent, F.when(fits, owner).otherwise(state[parent]))
    return state


def active_filters(state: Column) -> Column:
    """array of struct(key, label, value) of the filters in force; a department stands for its division, an area for its field."""
    one = lambda key, label, value: F.struct(F.lit(key).alias("key"), F.lit(label).alias("label"), value.alias("value"))
    found = [
        F.when(state["saved_only"], one("saved_only", "Saved", F.lit("only"))), F.when((state["field"] != "all") & (state["area"] == "all"), one("field", "Field", state["field"])),
        F.when(state["area"] != "all", one("area", "Area", state["area"])), F.when((state["division"] != "all") & (state["department"] == "all"), one("division", "School", state["division"])),
        F.when(state["department"] != "all", one("department", "Dept", state["department"])), F.when(state["verified_only"], one("verified_only", "Evidence", F.lit("Source checked"))),
    ]
    kinds = F.transform(evidence_keys(state["evidence"]), lambda k: F.struct(F.concat(F.lit("evidence:"), k).alias("key"), F.lit("Evidence").alias("label"), k.alias("value")))
    last = F.array_compact(F.array(F.when(state["recruiting"] != "all", one("recruiting", "Status", state["recruiting"]))))
    return F.concat(F.array_compact(F.array(*found)), kinds, last)


def numeric_metric(value: Column) -> Column:
    number = value.try_cast("double")
    return F.coalesce((number >= 0) & ~F.isnan(number) & (number < float("inf")), F.lit(False))


def academic_metrics(citations: Column, works: Column, h_index: Column, source: Column, verified: Column) -> Column:
    """struct(has_metrics, verified, citations, status): numbers are shown only of a verified match."""
    has = numeric_metric(citations) | numeric_metric(works) | numeric_metric(h_index)
    sure = has & F.coalesce(verified, F.lit(False))
    return F.struct(
        has.alias("has_metrics"), sure.alias("verified"), F.when(sure & numeric_metric(citations), citations.try_cast("double")).otherwise(-1.0).alias("citations"),
        F.when(sure, F.concat(source, F.lit(" verified"))).when(has, F.concat(source, F.lit(" needs review"))).otherwise("Not verified").alias("status"),
    )


def faculty_label(legacy: Column, appointment: Column) -> Column:
    """A reader's words for a person's state; an older role outranks the appointment."""
    words = lambda m, key: F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), key)
    old = {"emeritus": "Emeritus faculty", "former": "Former faculty · directory", "deceased": "Deceased · directory"}
    new = {
        "listed_faculty": "Listed in official faculty directory", "affiliate": "Affiliate · directory", "emeritus": "Emeritus faculty", "lecturer": "Lecturer · directory",
        "adjunct": "Adjunct faculty · directory",
    }
    listed = F.when(legacy == "listed_in_official_directory", "Listed in official directory").otherwise("Status not verified")
    return F.coalesce(words(old, F.coalesce(legacy, F.lit(""))), words(new, F.coalesce(appointment, F.lit(""))), listed)


def relevant(papers: DataFrame, key: str, paper: str, own: Column, tokens: Column, date: Column) -> DataFrame:
    """(key, paper, shared): papers that share tokens with their record, the best first by rank. own, tokens: arrays of distinct tokens."""
    from pyspark.sql import Window

    scored = papers.withColumn("shared", F.size(F.array_intersect(own, tokens))).where("shared > 0")
    order = Window.partitionBy(key).orderBy(F.desc("shared"), F.desc_nulls_last(date), paper)
    return scored.select(key, paper, "shared", F.row_number().over(order).alias("place"))


def unified(**tables: DataFrame) -> DataFrame:
    """Tables of several kinds as one record model, with their kind; columns that a kind lacks are null."""
    first, *rest = [df.withColumn("record_type", F.lit(kind)) for kind, df in tables.items()]
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first
