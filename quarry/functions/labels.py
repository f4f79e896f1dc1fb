"""Labels of laboratories, departments, titles, contacts and courses. All are native column expressions; null counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.names import capitalised, last_name, normalized, squeezed
from quarry.functions.text import fold_text, is_known, normalize, to_ascii
from quarry.functions.urls import LAB_TOKEN, decoded

# Fixed values.
STOPWORDS = ("and", "array", "course", "department", "for", "from", "into", "the", "their", "with")
LAB_WORD = r"(?i)\b(?:lab(?:orator(?:y|ies))?|(?:research )?group)\b"
GENERIC_LABS = r"(?i)^(?:(?:research|faculty|all|our|department) )?(?:labs|laboratories|research groups)(?: directory| websites?)?$"
NOT_A_LAB = (
    r"(?i)\b(?:laboratory safety|lab safety|lab coat|clinical laboratory|lab resources|laboratory services|teaching laboratory|undergraduate laboratory|laboratory study|lab study|"
    r"journal|editor|reading group|working group|workshop|conference|seminar|proceedings|publications?|articles?|papers?)\b|"
    "^(?:about|join|support|donate|contact|between|I |we )\\b|[“”\"]"
)
GENERIC_LINK = r"(?i)^(?:my |our |the |visit |view )?(?:research )?(?:lab(?:oratory)?|research group)(?: (?:web ?site|site|homepage|page))?$"
UNSPECIFIC = "lab (?:logo|brand|safety|fun|personnel|alumni)|visual identity|brand guidelines|teaching lab|laboratories for accelerating|resource group|support group|support network|nonforprofit|nonprofit"
TITLES = (
    "assistant teaching professor", "associate teaching professor", "teaching professor", "assistant professor", "associate professor", "professor", "research scientist", "lecturer",
    "faculty",
)
SIGNALS = (
    "aging", "autism", "behavior", "biology", "brain", "cancer", "cell", "clinical", "cognition", "disease", "genetic", "health", "imaging", "immune", "language", "learning", "memory",
    "neural", "neuro", "policy", "repair", "science", "systems",
)
INTERESTS = (
    (("bio",), ("Biology", "Biomedical science")), (("chem",), ("Chemistry",)), (("physics", "astronomy"), ("Physics",)), (("math",), ("Mathematics",)), (("engineering",), ("Engineering",)),
    (("medicine", "surgery", "pediatric", "health"), ("Health", "Medicine")), (("computer", "data"), ("Computer science", "Data science")),
    (("psych", "cognitive", "neuro"), ("Cognition", "Neuroscience")),
)
EMAIL, PHONE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}"
MAILBOXES = ("communication", "feedback", "info", "support", "webmaster")
SHARED_TOKENS = ("admin", "contact", "info", "media", "support", "web", "webmaster", "dept", "faculty", "grad")


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def title_words(value: Column) -> Column:
    """Words of a slug with a capital each."""
    parts = F.array_remove(F.split(_text(value), r"[\s_-]+"), "")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def department_key(value: Column) -> Column:
    """The plain name of a department, whatever it is called by: no parentheses, '&' as 'and', no 'department (of)'."""
    key = F.regexp_replace(F.regexp_replace(fold_text(value), r"\([^)]*\)", " "), "&", " and ")
    key = F.trim(F.regexp_replace(key, r"[^\p{L}\p{N}]+", " "))
    return F.regexp_replace(F.regexp_replace(key, "^(the )?department of ", ""), " department$", "")


def unit_of_title(title: Column) -> Column:
    """What follows the first comma of a title, up to the next title."""
    rest = F.regexp_extract(_text(title), "(?s)^[^,]*,(.*)$", 1)
    rest = F.regexp_extract(rest, r"(?is)^(.*?)(?:\b(?:(?:Assistant|Associate|Adjunct|Clinical|Teaching|Research)\s+)*(?:Professor|Lecturer)\b.*)?$", 1)
    return F.regexp_replace(F.regexp_replace(rest, r"^[\s,;]+|[\s,;]+$", ""), r"(?i)^Department of\s+", "")


def quoted(value: Column) -> Column:
    """A text as a pattern that matches it alone."""
    return F.regexp_replace(_text(value), r"([.*+?^${}()|\[\]\\])", r"\\$1")


def token_set(value: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Distinct tokens of three characters or more that are no numbers and no stop words; markup is dropped before."""
    plain = F.regexp_replace(_text(value), "<[^>]*>", " ")
    found = F.filter(F.split(normalize(plain), r"\s+"), lambda t: (F.length(t) > 2) & ~t.rlike(r"^\d+$"))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, stopwords)))


def highlighter(words: list[str], abbreviations: tuple[str, ...] = ()) -> str:
    """A pattern of the words, longest first; short ones at the beginning of a word, abbreviations as whole words."""
    import re

    usable = sorted(dict.fromkeys(w for w in words if len(w) > 1), key=lambda w: -len(w))
    one = lambda w: re.escape(w) if len(w) > 2 or not w.isascii() else rf"\b{re.escape(w)}" + (r"\b" if w in abbreviations else "")
    return "(?i)" + "|".join(map(one, usable)) if usable else ""


def highlighted(value: Column, words: list[str], abbreviations: tuple[str, ...] = (), begin: str = "<mark>", end: str = "</mark>") -> Column:
    """The text with its matches marked."""
    pattern = highlighter(words, abbreviations)
    return F.regexp_replace(_text(value), f"({pattern})" if not pattern.startswith("(?i)") else f"(?i)({pattern[4:]})", f"{begin}$1{end}") if pattern else _text(value)


def lab_label(value: Column) -> Column:
    """struct(name, descriptor) of a label such as 'Name Lab - what it does | site'."""
    text = F.regexp_replace(squeezed(value), r"^[ \-*–—|]+|[ \-*–—|]+$", "")
    text = F.regexp_replace(text, r"\s+\|\s+.*$", "")
    name = squeezed(F.regexp_extract(text, r"^(.*?)(?:\s+[–—-]\s+.*)?$", 1))
    return F.struct(name.alias("name"), squeezed(F.regexp_extract(text, r"^.*?\s+[–—-]\s+(.*)$", 1)).alias("descriptor"))


def direction_phrase(value: Column) -> Column:
    """A research direction without laboratory words, short parentheses and articles."""
    phrase = F.regexp_replace(squeezed(value), r"\([^)]{1,12}\)", "")
    phrase = F.regexp_replace(phrase, r"(?i)\b(?:lab|labs|laboratory|laboratories|research group|group)\b", " ")
    for pattern in (r"(?i)^center for\s+", r"(?i)\s+center$", r"(?i)^(?:for|of|the)\s+"):
        phrase = F.regexp_replace(phrase, pattern, "")
    return squeezed(F.regexp_replace(phrase, r"^[ \-*–—|]+|[ \-*–—|]+$", ""))


def research_signal(value: Column) -> Column:
    return _any(F.lower(_text(value)), SIGNALS)


def likely_direction(value: Column) -> Column:
    """A phrase of 4 to 80 characters; one word, or up to three capitalised ones, only with a signal of research."""
    phrase = direction_phrase(value)
    words = F.split(phrase, r"\s+")
    furniture = F.lower(phrase).isin("home", "homepage", "website", "research", "project", "program", "study")
    titled = (F.size(words) <= 3) & F.forall(words, lambda w: w.rlike(r"^\p{Lu}"))
    return F.length(phrase).between(4, 80) & ~furniture & (research_signal(phrase) | ~((F.size(words) == 1) | titled))


def department_interests(department: Column, school: Column) -> Column:
    """The department and the subjects that its name and its school's tell, sorted."""
    value = F.lower(F.concat_ws(" ", _text(department), _text(school)))
    found = [department] + [F.when(_any(value, words), F.lit(s)) for words, subjects in INTERESTS for s in subjects]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def labels_of(text: Column, keywords: dict[str, list[str]], limit: int = 7) -> Column:
    """Labels of which a keyword stands in the text, in order of the dictionary, at most ``limit`` (the report's length)."""
    hay = F.concat(F.lit(" "), F.lower(_text(text)), F.lit(" "))
    return F.slice(F.array_compact(F.array(*[F.when(_any(hay, tuple(words)), F.lit(label)) for label, words in keywords.items()])), 1, limit)


def label_key(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(to_ascii(value)), "[^a-z0-9]+", " "))


def lab_key(value: Column) -> Column:
    """Identity of a named laboratory; empty where the name says only that it is one."""
    key = F.regexp_replace(label_key(value), r"\blaborator(?:y|ies)\b", "lab")
    key = squeezed(F.regexp_replace(key, r"\bthe\b", ""))
    return F.when(key.isin("", "lab", "lab website", "research group", "website"), "").otherwise(key)


def same_lab(name: Column, leader: Column, other: Column, other_leader: Column) -> Column:
    """Equal names whose leaders, where both are known, agree."""
    known = lambda p: ~label_key(p).isin("", "not found", "unknown")
    return (lab_key(name) != "") & (lab_key(name) == lab_key(other)) & ~(known(leader) & known(other_leader) & (label_key(leader) != label_key(other_leader)))


def lab_identity(value: Column) -> Column:
    """A laboratory's name without words of web sites."""
    text = F.regexp_replace(normalized(value), r"\blaborator(?:y|ies)\b", "lab")
    return F.trim(F.regexp_replace(text, r"\b(?:the|website|web|site|homepage|home|welcome|to|visit|at)\b", ""))


def base_lab_name(value: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.lower(_text(value)), r"\.html?$", ""), r"\b(lab|laboratory|research group|group|center|centers and labs|affiliates)\b", "")
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def shown_lab_name(name: Column, leader: Column) -> Column:
    """A name to show: no file ending, no shouting; a generic one is named after the leader, and 'Lab' is added where nothing says so."""
    text = F.trim(F.regexp_replace(F.trim(_text(name)), r"(?i)\.html?$", ""))
    shouted = (F.upper(text) == text) & (F.lower(text) != text) & (F.size(F.split(text, r"\s+")) <= 3)
    text = F.when(shouted, F.array_join(F.transform(F.split(text, r"\s+"), capitalised), " ")).otherwise(text)
    led = _text(leader) != ""
    generic = F.lower(text).isin("lab / research", "lab site", "research", "website", "source")
    return (
        F.when(led & generic, F.concat(last_name(leader), F.lit(" Lab"))).when(led & ~_any(F.lower(text), ("lab", "research group", "center")), F.concat(text, F.lit(" Lab")))
        .when(text != "", text).when(led, F.concat(last_name(leader), F.lit(" Lab"))).otherwise("Research Lab")
    )


def entity_type(name: Column, url: Column, kind: Column) -> Column:
    """The first of the kinds of entity that name, URL or kind speak of; a laboratory otherwise."""
    value = F.lower(F.concat_ws(" ", _text(name), _text(url), _text(kind)))
    found = F.when(F.contains(value, F.lit("research group")), "research_group")
    for word in ("core", "clinic", "studio", "observatory", "facility", "institute", "center"):
        found = found.when(_any(value, (word, "centre") if word == "center" else (word,)), word)
    return found.otherwise("lab")


def confidence(leader: Column, sources: Column, kind: Column) -> Column:
    """high for a curated record with a leader, medium for a leader or a second source, low otherwise."""
    led = is_known(leader)
    return F.when(kind.isin("curated_lab", "faculty_lab_link") & led, "high").when(led | (F.size(sources) > 1), "medium").otherwise("low")


def valid_lab_label(label: Column) -> Column:
    return label.rlike(LAB_WORD) & ~squeezed(label).rlike(GENERIC_LABS) & (F.length(label) <= 150) & ~label.rlike(NOT_A_LAB)


def specific_lab_name(name: Column) -> Column:
    """Whether a name has a word of its own beside laboratory and site words."""
    text = label_key(name)
    own = F.trim(F.regexp_replace(text, r"\b(?:the|lab|laboratory|laboratories|group|research|website|web|site|home|homepage|at|of|university|visit)\b", ""))
    return ~text.rlike(UNSPECIFIC) & (own != "") & text.rlike(r"\blab\b|laborator|\bgroup\b")


def generic_lab_name(value: Column, methods: Column) -> Column:
    """Whether all proofs of a name are of generic links, or an old proof is of a label that says nothing."""
    said = F.endswith(value, F.lit(" — lab website")) | value.rlike(GENERIC_LINK)
    return (F.size(methods) > 0) & (F.forall(methods, lambda m: F.endswith(m, F.lit("_generic_lab_link"))) | (said & F.array_contains(methods, "official_profile_explicit_lab_link")))


def looks_like_lab(name: Column, url: Column, text: Column, led: Column, explicit: Column, leader: Column, bad_names: tuple[str, ...] = (), bad_parts: tuple[str, ...] = ()) -> Column:
    """Evidence of a laboratory: a word for one in name, text or URL, or an explicit label with a leader whose name or research is in the URL."""
    hay, link = F.lower(F.concat_ws(" ", _text(name), _text(url), _text(text))), F.regexp_replace(F.lower(_text(url)), r"[?#].*$", "")
    bad = ~is_known(url) | _any(hay, bad_parts) | (F.lower(F.trim(_text(name))).isin(*bad_names) if bad_names else F.lit(False))
    person = F.lower(last_name(leader))
    named = explicit & led & (((F.length(person) >= 3) & F.contains(link, person)) | F.contains(link, F.lit("research")))
    return F.coalesce(url.rlike("(?i)^https?://"), F.lit(False)) & ~bad & (hay.rlike(LAB_TOKEN) | link.rlike(LAB_TOKEN) | named)


def appointment_status(role: Column, section: Column) -> Column:
    """What a directory says of an appointment, the strongest word first."""
    value = F.concat_ws(" ", _text(role), _text(section))
    found = F.when(value.rlike("(?i)deceased|memoriam"), "deceased").when(value.rlike("(?i)former|alumni"), "former").when(value.rlike("(?i)emerit"), "emeritus")
    found = found.when(value.rlike("(?i)adjunct"), "adjunct").when(value.rlike("(?i)affiliat"), "affiliate")
    return found.when(role.rlike("(?i)lecturer") & ~role.rlike("(?i)professor"), "lecturer").otherwise("listed_faculty")


def title_score(title: Column) -> Column:
    """Rank of a title: the known ones in order, other professors 5, other titles 2, none 0."""
    text = F.lower(squeezed(title))
    known = F.array_position(F.array(*map(F.lit, TITLES)), text)
    return F.when(known > 0, len(TITLES) - known + 1).when(F.contains(text, F.lit("professor")), 5).when(text != "", 2).otherwise(0).cast("int")


def academic_clause(title: Column) -> Column:
    return _text(title).rlike(r"(?i)\b(?:professor|lecturer|faculty|scientist|instructor)\b")


def low_information(summary: Column) -> Column:
    """Missing, under 90 characters, or a stock phrase."""
    text = F.trim(_text(summary))
    return ~is_known(text) | (F.length(text) < 90) | F.lower(text).rlike("^(?:faculty listing from|public )") | F.contains(F.lower(text), F.lit("profile, lab and email links need"))


def resource_areas(title: Column, description: Column, kind: Column) -> Column:
    """What a resource offers, in a fixed order."""
    text = normalize(F.concat_ws(" ", title, description, kind))
    found = [F.lit("Experiential learning")]
    for word, area in (("research", "Research"), ("intern", "Internship"), ("volunteer", "Volunteer")):
        found.append(F.when(F.contains(text, F.lit(word)), area))
    return F.array_compact(F.array(*found, F.when(F.contains(text, F.lit("co curricular")) | F.coalesce(kind == "Co-curricular", F.lit(False)), "Co-curricular")))


def course_code(value: Column, prefix: str = "") -> Column:
    """'SUBJ 12A' of a course's beginning, without leading zeros; null where there is none."""
    text = F.concat(F.lit(f"{prefix} "), squeezed(value)) if prefix else squeezed(value)
    pattern = r"(?i)^([A-Z]{2,5})[ -]*(\d+[A-Z]*)(?:\b|[ .:])"
    number = F.regexp_replace(F.upper(F.regexp_extract(text, pattern, 2)), r"^0+(?=\d)", "")
    return F.when(number != "", F.concat_ws(" ", F.upper(F.regexp_extract(text, pattern, 1)), number))


def term_label(code: Column) -> Column:
    """FA26 as Fall 2026; null for other codes."""
    season = F.create_map(F.lit("FA"), F.lit("Fall"), F.lit("WI"), F.lit("Winter"), F.lit("SP"), F.lit("Spring"))
    return F.concat(F.try_element_at(season, F.substring(code, 1, 2)), F.lit(" 20"), F.substr(code, F.lit(3)))


def stripped(fragment: Column) -> Column:
    """A fragment of markup as one line."""
    return squeezed(F.regexp_replace(F.replace(_text(fragment), F.lit("&nbsp;"), F.lit(" ")), "<[^>]+>", " "))


def first_phone(text: Column) -> Column:
    return F.regexp_extract(_text(text), PHONE, 0)


def public_email(value: Column) -> Column:
    """The single address of a mailto value; empty for several or none."""
    text = F.regexp_replace(F.trim(_text(value)), "(?i)^mailto:", "")
    text = F.regexp_replace(F.trim(F.regexp_replace(text, "[?#].*$", "")), "^//", "")
    return F.when(text.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"), text).otherwise("")


def clean_email(value: Column) -> Column:
    """The first address of a link's value, escapes undone, in lower case."""
    text = F.regexp_replace(F.regexp_replace(decoded(_text(value)), "[mM]ailto:", ""), r"\?.*$", "")
    return F.lower(F.regexp_extract(text, EMAIL, 0))


def email_allowed(email: Column, excluded: tuple[str, ...] = MAILBOXES) -> Column:
    return (_text(email) != "") & ~F.lower(F.split_part(_text(email), F.lit("@"), F.lit(1))).isin(*excluded)


def page_emails(text: Column, hrefs: Column) -> Column:
    """All personal addresses of a page's text and links, sorted."""
    found = F.concat(F.regexp_extract_all(_text(text), F.lit(EMAIL), F.lit(0)), F.transform(hrefs, clean_email))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, F.lower), lambda e: email_allowed(e))))


def generic_email(email: Column, uses: Column) -> Column:
    """A mailbox by its name, or by how many share it."""
    return (uses > 3) | _any(F.lower(F.split_part(email, F.lit("@"), F.lit(1))), SHARED_TOKENS)


def principal_investigator(text: Column) -> Column:
    """The name after 'Principal Investigator' or 'PI'; empty without one."""
    return F.regexp_extract(_text(text), r"(?:Principal Investigator|PI)\s*[:\-–]\s*(?:Dr\.?\s+|Prof(?:essor|\.)?\s+)?([A-Z][\w.'-]+(?:\s+[A-Z][\w.'-]+){1,3})", 1)


def eligible_directory(label: Column, path: Column) -> Column:
    """Whether a link leads to a listing of people or laboratories; words that the label itself excuses do not count against it."""
    wanted = r"(?i)faculty|research|laborator|\blabs?\b|\bgroups?\b|centers?|centres?|institutes?|\bpeople\b"
    unwanted = (
        r"(?i)news|events?|seminars?|publications?|papers?|giving|donate|alumni|jobs?|careers?|admissions?|courses?|syllabus|search|login|calendar|resources|funding|awards?|safety|forms?|"
        r"training|graduate|undergraduate|postdoc|staff|positions|opportunit|facilities|equipment"
    )
    both = F.concat_ws(" ", _text(label), _text(path))
    both = F.when(label.rlike("(?i)faculty"), F.regexp_replace(both, "(?i)staff|graduate|undergraduate", "")).otherwise(both)
    both = F.when(label.rlike("(?i)lab|laborator"), F.regexp_replace(both, "(?i)facilities|equipment", "")).otherwise(both)
    return _text(label).rlike(wanted) & ~both.rlike(unwanted)
