"""A taxonomy of divisions, departments, fields and subfields, and what of it a record belongs to.

The taxonomy is data: lists of entries that a caller gives. Its size is that of an institution, not of the records, so it becomes
column expressions, and records are classified in one pass without a join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.labels import department_key
from quarry.functions.names import squeezed
from quarry.functions.text import fold_text, is_known

OTHER = "other"


@dataclass(frozen=True)
class Department:
    name: str
    division: str
    aliases: tuple[str, ...] = ()


@dataclass(frozen=True)
class Subfield:
    id: str
    label: str
    field: str
    patterns: tuple[str, ...]
    aliases: tuple[str, ...] = ()


@dataclass(frozen=True)
class Taxonomy:
    """divisions: id -> (label, pattern for departments that are not listed, or empty), in the order in which patterns are tried."""

    divisions: dict[str, tuple[str, str]]
    departments: tuple[Department, ...] = ()
    fields: dict[str, str] = field(default_factory=dict)
    subfields: tuple[Subfield, ...] = ()

    def department(self, raw: Column) -> Column:
        """struct(name, division) of a department's name: the listed one, else as it is in the first division whose pattern fits; null for none."""
        key = department_key(raw)
        names = F.array(*[F.struct(F.lit(self._key(n)).alias("key"), F.lit(d.name).alias("name"), F.lit(d.division).alias("division")) for d in self.departments for n in (d.name, *d.aliases)])
        known = F.get(F.filter(names, lambda d: d["key"] == key), F.lit(0)) if self.departments else F.lit(None)
        division = F.lit(None).cast("string")
        for own, (_, pattern) in reversed(self.divisions.items()):
            if pattern:
                division = F.when(key.rlike(pattern), own).otherwise(division)
        found = F.struct(F.regexp_replace(squeezed(raw), "<[^>]*>", " ").alias("name"), F.coalesce(division, F.lit(OTHER)).alias("division"))
        listed = F.when(known.isNotNull(), F.struct(known["name"].alias("name"), known["division"].alias("division"))) if self.departments else F.lit(None)
        return F.when(key != "", F.coalesce(listed, found))

    @staticmethod
    def _key(name: str) -> str:
        """``department_key`` of a value."""
        import re

        from quarry.functions.text import folded

        text = re.sub(r"&", " and ", re.sub(r"\([^)]*\)", " ", folded(name)))
        text = " ".join(re.sub(r"[^\w]+|_", " ", text).split())
        return re.sub(r" department$", "", re.sub(r"^(the )?department of ", "", text))

    def subfields_of(self, text: Column) -> Column:
        """Ids of the subfields of which a pattern begins a word of the text."""
        low = F.lower(F.coalesce(text, F.lit("")))
        return F.array_compact(F.array(*[F.when(low.rlike(rf"\b(?:{'|'.join(s.patterns)})"), F.lit(s.id)) for s in self.subfields]))

    def fields_of(self, subfields: Column) -> Column:
        """Fields of subfields, in the taxonomy's order."""
        has = [F.when(F.arrays_overlap(subfields, F.array(*[F.lit(s.id) for s in self.subfields if s.field == f] or [F.lit("")])), F.lit(f)) for f in self.fields]
        return F.array_compact(F.array(*has))

    def classify(self, records: DataFrame, departments: Column, areas: Column, text: Column) -> DataFrame:
        """records with departments (name and division, each name once), divisions, subfields and fields; areas outrank the text where they tell any."""
        resolved = F.array_compact(F.transform(departments, self.department))
        once = F.filter(resolved, lambda d, i: F.coalesce(F.array_position(F.transform(resolved, lambda x: x["name"]), d["name"]), F.lit(0)) == i + 1)
        by_area, by_text = self.subfields_of(F.array_join(areas, "; ")), self.subfields_of(text)
        own = F.when(F.size(by_area) > 0, by_area).otherwise(by_text)
        marked = records.withColumns({"departments_": once, "subfields": own})
        return marked.withColumns({"divisions": F.array_distinct(F.transform("departments_", lambda d: d["division"])), "fields": self.fields_of(F.col("subfields"))})

    def terms(self, spark, records: DataFrame | None = None) -> DataFrame:  # noqa: ANN001
        """(kind, label, alias) of all entries, for suggestions and synonyms."""
        rows = [("division", label, label) for label, _ in self.divisions.values()] + [("field", v, v) for v in self.fields.values()]
        rows += [("department", d.name, a) for d in self.departments for a in (d.name, *d.aliases)] + [("area", s.label, a) for s in self.subfields for a in (s.label, *s.aliases)]
        return spark.createDataFrame(rows, "kind string, label string, alias string")

    def synonyms(self) -> dict[str, list[str]]:
        """Words of scripts without spaces and the labels that they stand for."""
        found: dict[str, list[str]] = {}
        for label, aliases in [*((s.label, s.aliases) for s in self.subfields), *((d.name, d.aliases) for d in self.departments)]:
            for a in aliases:
                if any("㐀" <= c <= "鿿" for c in a):
                    found.setdefault(a, []).append(label)
        return found


def department_names(own: Column, affiliations: Column, listings: Column) -> Column:
    """A record's departments from its field, its affiliations and directory listings, known ones once by their folded names."""
    each = F.filter(F.concat(F.array(own), F.coalesce(affiliations, F.array().cast("array<string>")), F.coalesce(listings, F.array().cast("array<string>"))), lambda d: F.coalesce(is_known(d), F.lit(False)))
    keys = F.transform(each, fold_text)
    return F.filter(each, lambda d, i: F.array_position(keys, fold_text(d)) == i + 1)


def lent_departments(labs: DataFrame, people: DataFrame, lab: str, leader: str, person: str) -> DataFrame:
    """(lab, departments): laboratories without departments of their own take those of their leaders. labs: lab, leader, departments; people: person, departments."""
    own = labs.select(lab, leader, F.col("departments").alias("_own"))
    lent = people.select(F.col(person).alias(leader), F.col("departments").alias("_lent"))
    return own.join(lent, leader, "left").select(lab, F.when(F.size("_own") > 0, F.col("_own")).otherwise(F.coalesce("_lent", F.array().cast("array<string>"))).alias("departments"))
