"""Review decisions: verified against captures as a whole batch, then applied with history.

A decision names a subject, what is to be done with it and why, pins the hash of the record it was made for, and carries proofs.
A proof is struct(capture, sha256, observed_at, final_url, kind, evidence, label, target). A batch is applied only if
no decision breaks a rule. Decisions meet records, captures and each other in equality joins; proofs are exploded and counted back, so
a batch of any size is verified in parallel.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.html import plain, title
from quarry.functions.names import squeezed

#: Kinds of proof, and what each requires of its capture.
KINDS = ("main_text_quote", "document_title", "document_heading", "document_link", "html_attribute", "redirect_chain")


@dataclass(frozen=True)
class Schema:
    """What decisions of a kind must be: their actions, proof kinds, the fields they set, and whether a target record is named."""

    name: str
    actions: tuple[str, ...]
    kinds: tuple[str, ...] = KINDS
    fields: tuple[str, ...] = ()
    targets: bool = False
    rules: dict[str, Column] = field(default_factory=dict)


# What the reviews of each kind decide.
SCHEMAS = {
    s.name: s
    for s in (
        Schema("identity_merge", ("merge",), targets=True), Schema("person_identity", ("merge", "correct"), targets=True), Schema("profile_binding", ("bind",), ("document_title", "document_heading", "main_text_quote"), ("officialProfileUrl",)),
        Schema("career_identity", ("bind",), ("main_text_quote", "document_heading")), Schema("profile_chain", ("bind",), ("redirect_chain", "document_heading")), Schema("shared_primary", ("share",), targets=True),
        Schema("resource_label", ("label",), ("document_title", "document_heading", "document_link")), Schema("department_normalization", ("normalize",), fields=("department",)),
        Schema("lab_fields", ("set",), fields=("principalInvestigator", "contactEmail", "description")), Schema("own_metadata", ("set",), ("html_attribute", "document_title", "main_text_quote"), ("labName", "description")),
        Schema("ownership", ("own", "disown"), targets=True), Schema("preferred_resource", ("prefer",), ("redirect_chain", "document_link", "document_title"), ("labWebsiteUrl",)),
        Schema("resource_association", ("associate", "record_resource_mismatch"), targets=True), Schema("resource_review", ("register",)), Schema("campus_group", ("register",)), Schema("program_affiliation", ("affiliate",), targets=True),
        Schema("source_upgrade", ("upgrade",), ("redirect_chain", "document_heading"), ("sourceUrl",)), Schema("shared_resource", ("share",), targets=True), Schema("published_organization", ("register",)),
        Schema("professor_fields", ("set",), ("main_text_quote",), ("researchAreas", "researchSummary")), Schema("contact_scope", ("withdraw", "limit"), fields=("email",)), Schema("research_scope", ("limit",), fields=("researchSummary",)),
        Schema("profile_link", ("needs_review",), fields=("officialProfileUrl",)), Schema("biography", ("set",), ("main_text_quote",), ("researchSummary",)), Schema("destination_identity", ("mismatch", "confirm")),
    )
}


def record_sha256(record: Column) -> Column:
    """SHA-256 of the canonical JSON of a record: keys sorted, as VARIANT writes them."""
    return F.sha2(F.to_json(F.parse_json(F.to_json(record))), 256)


def proof_holds(kind: Column, evidence: Column, body: Column, redirects: Column, label: Column, target: Column) -> Column:
    """Whether the evidence stands in a capture as its kind says."""
    headings = F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>"), F.lit(1)), plain)
    anchors = F.regexp_extract_all(body, F.lit(r"(?is)<a\s[^>]*>.*?</a>"), F.lit(0))
    linked = F.exists(anchors, lambda a: (plain(a) == label) & F.contains(a, F.concat(F.lit('"'), target, F.lit('"'))))
    attribute = F.contains(body, F.concat(label, F.lit('="'), target, F.lit('"')))
    return F.coalesce(
        F.when(F.coalesce(evidence, F.lit("")) == "", False).when(kind == "main_text_quote", F.contains(plain(body), squeezed(evidence))).when(kind == "document_title", title(body) == evidence)
        .when(kind == "document_heading", F.array_contains(headings, evidence)).when(kind == "document_link", linked & (evidence == F.concat(label, F.lit(" -> "), target)))
        .when(kind == "html_attribute", attribute & (evidence == F.concat(label, F.lit(" = "), target))).when(kind == "redirect_chain", (F.size(redirects) > 0) & (F.array_join(redirects, " -> ") == evidence)),
        F.lit(False),
    )


def checked_proofs(decisions: DataFrame, captures: DataFrame) -> DataFrame:
    """decision, place, reason: why each proof fails, or an empty text. captures: capture, status, body, sha256, observed_at, final_url, redirects."""
    each = decisions.select("decision", F.posexplode("proofs").alias("place", "p"))
    met = each.join(captures.select(F.col("capture").alias("_c"), F.struct("status", "body", "sha256", "observed_at", "final_url", "redirects").alias("c")), F.col("p.capture") == F.col("_c"), "left")
    reason = (
        F.when(F.col("c").isNull(), "no_capture").when(F.col("c.status") != "ok", "capture_failed").when(~F.col("p.final_url").eqNullSafe(F.col("c.final_url")), "other_page")
        .when(~F.col("p.observed_at").eqNullSafe(F.col("c.observed_at")), "other_time").when((F.sha2("c.body", 256) != F.col("p.sha256")) | (F.col("c.sha256") != F.col("p.sha256")), "body_changed")
        .when(~proof_holds(F.col("p.kind"), F.col("p.evidence"), F.col("c.body"), F.col("c.redirects"), F.col("p.label"), F.col("p.target")), "evidence_not_found").otherwise("")
    )
    return met.select("decision", "place", reason.alias("reason"))


def verify(decisions: DataFrame, records: DataFrame, captures: DataFrame, schema: Schema) -> DataFrame:
    """decision and failures (sorted; empty for a decision that may be applied).

    decisions: decision, action, subject, target, reason, sha256 (of the subject's record), field, value, proofs. records: id, alias_ids, sha256.
    Decisions must be distinct by subject and acyclic (no subject is a target); a subject without record must be an alias of its target.
    """
    failed = checked_proofs(decisions, captures).where("reason <> ''").groupBy("decision").agg(F.collect_set("reason").alias("proofs_failed"))
    times = decisions.groupBy("subject").agg(F.count("*").alias("times"))
    aims = decisions.where("target is not null").select(F.col("target").alias("subject")).distinct().withColumn("is_target", F.lit(True))
    subject = records.select(F.col("id").alias("subject"), F.col("sha256").alias("found"))
    target = records.select(F.col("id").alias("target"), F.col("alias_ids").alias("target_aliases"), F.lit(True).alias("target_exists"))
    wide = decisions.join(failed, "decision", "left").join(times, "subject", "left").join(aims, "subject", "left").join(subject, "subject", "left").join(target, "target", "left")
    alias = F.coalesce(F.array_contains("target_aliases", F.col("subject")), F.lit(False))
    rules = {
        "action": ~F.col("action").isin(*schema.actions), "no_reason": F.trim(F.coalesce("reason", F.lit(""))) == "", "no_proof": F.coalesce(F.size("proofs"), F.lit(0)) < 1,
        "kind": F.exists("proofs", lambda p: ~p["kind"].isin(*schema.kinds)), "repeated": F.col("times") > 1, "cyclic": F.col("is_target").isNotNull(), "record_changed": F.col("found") != F.col("sha256"),
        "no_subject": F.col("found").isNull() & ~alias,
    }
    if schema.targets:
        rules["no_target"] = F.col("target_exists").isNull()
    if schema.fields:
        rules["field"] = ~F.col("field").isin(*schema.fields)
    rules |= schema.rules
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(name in ("action", "field"))), F.lit(name)) for name, bad in rules.items()]))
    return wide.select("decision", F.array_sort(F.concat(broken, F.coalesce("proofs_failed", F.array().cast("array<string>")))).alias("failures"))


def batch_valid(verified: DataFrame) -> bool:
    return verified.where(F.size("failures") > 0).isEmpty()


def apply_merges(records: DataFrame, decisions: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, references, archive) after decisions that merge subjects into targets. decisions: decision, subject, target, reason; verified.

    Targets take the ids and aliases of their subjects, references follow, repeated references count once, and merged records are archived.
    """
    aims = decisions.select("subject", "target", "decision", "reason")
    gone = records.join(aims, records["id"] == aims["subject"]).select(*records.columns, "target", "decision", "reason")
    taken = gone.select("target", F.explode(F.array_union(F.array("id"), F.coalesce("alias_ids", F.array().cast(records.schema["alias_ids"].dataType)))).alias("alias"))
    aliases = taken.groupBy("target").agg(F.array_sort(F.collect_set("alias")).alias("_more"))
    left = records.join(aims, records["id"] == aims["subject"], "left_anti").join(aliases, records["id"] == aliases["target"], "left")
    all_aliases = F.array_sort(F.array_distinct(F.concat(F.coalesce("alias_ids", F.array().cast(records.schema["alias_ids"].dataType)), F.coalesce("_more", F.array().cast(records.schema["alias_ids"].dataType)))))
    kept = left.withColumn("alias_ids", all_aliases).select(*records.columns)
    moved = references.join(aims.select("subject", "target"), references["id"] == aims["subject"], "left")
    moved = moved.withColumn("id", F.coalesce("target", "id")).select(*references.columns).distinct()
    return kept, moved, gone


def apply_fields(state: DataFrame, decisions: DataFrame) -> DataFrame:
    """The state after verified decisions that set or withdraw fields, as ``evidence.merge_observed`` of their proofs. state: entity, field, value, proofs."""
    from quarry.operators.evidence import merge_observed

    kind = state.schema["proofs"].dataType
    proofs = F.transform("proofs", lambda p: F.struct(p["final_url"].alias("source"), p["observed_at"].alias("observed_at"), F.lit("review").alias("method"), p["evidence"].alias("evidence")))
    batch = decisions.select(F.col("subject").alias("entity"), "field", "value", proofs.cast(kind).alias("proofs"))
    return merge_observed(state, batch)
