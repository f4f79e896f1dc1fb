"""URL functions. A resource URL names a transport resource; only url_key says that two are the same."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, _PARTS, k)


def valid_url(url: Column) -> Column:
    """http or https, with a host, without user information or white space; false for null."""
    scheme, authority = F.lower(_part(url, 1)), _part(url, 2)
    return F.coalesce(
        ~url.rlike(r"\s") & scheme.isin("http", "https") & ~F.contains(authority, F.lit("@")) & (F.regexp_extract(authority, r"^([^:]*)", 1) != ""), F.lit(False)
    )


#: Names of tracking parameters and index pages are those of ``comparison_key``'s patterns.
def url_key(url: Column) -> Column:
    """Identity of a resource: scheme and host in lower case, an empty path as /, no fragment; empty if invalid."""
    path = F.when(_part(url, 3) == "", "/").otherwise(_part(url, 3))
    query = F.when(F.length(_part(url, 4)) > 1, _part(url, 4)).otherwise("")
    key = F.concat(F.lower(_part(url, 1)), F.lit("://"), F.lower(_part(url, 2)), path, query)
    return F.when(valid_url(url), key).otherwise("")


def comparison_key(url: Column) -> Column:
    """Suggests variants for review: no scheme, www., index page, last slash or tracking parameters; empty if invalid.

    The URL is encoded first, and the query's pairs are decoded and encoded again, so that spellings of one query agree.
    """
    spaced = F.trim(url).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*\s")  # a host with white space is none
    url = encode_url(url)
    name = F.regexp_replace(F.lower(_part(url, 2)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(_part(url, 3), r"/+$", ""), r"/index\.(?:html?|php)$", "")
    plain = lambda p: F.url_encode(decoded(F.replace(p, F.lit("+"), F.lit(" "))))
    value = lambda p: F.regexp_extract(p, "^[^=]*=(.*)$", 1)
    pairs = F.filter(F.split(F.substr(_part(url, 4), F.lit(2)), "&"), lambda p: (p != "") & ~F.lower(p).rlike(r"^(utm_[^=]*|gclid|fbclid)(=|$)"))
    coded = F.transform(pairs, lambda p: F.concat(plain(F.split_part(p, F.lit("="), F.lit(1))), F.lit("="), plain(value(p))))
    query = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(coded, "&"))).otherwise("")
    return F.when(valid_url(url) & ~spaced, F.concat(name, path, query)).otherwise("")


def bare_host(url: Column) -> Column:
    """Host in lower case without port and user information; empty where there is none."""
    return F.lower(F.regexp_extract(F.regexp_replace(F.coalesce(_part(url, 2), F.lit("")), "^[^@]*@", ""), r"^([^:]*)", 1))


def decoded(text: Column) -> Column:
    """Percent escapes undone; text with broken ones stays."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))
#: Characters that a URL keeps; all others are written as percent escapes of their bytes.
_KEPT = r"A-Za-z0-9_.~:/?#\[\]@!$&'()*+,;=%-"
_KEPT_IN_PATH = r"A-Za-z0-9_.~/%:@!$&'()*+,;=-"


def _escaped(text: Column, kept: str) -> Column:
    runs = F.regexp_extract_all(text, F.lit(f"[{kept}]+|[^{kept}]+"), F.lit(0))
    coded = lambda r: F.replace(F.url_encode(r), F.lit("+"), F.lit("%20"))
    return F.when(text.rlike(f"[^{kept}]"), F.array_join(F.transform(runs, lambda r: F.when(r.rlike(f"^[{kept}]"), r).otherwise(coded(r))), "")).otherwise(text)


def encode_url(url: Column) -> Column:
    """Character references undone, trimmed, and what a URL cannot hold as percent escapes; legal characters stay."""
    text = F.trim(url)
    for reference, character in _ENTITIES:
        text = F.replace(text, F.lit(reference), F.lit(character))
    return _escaped(text, _KEPT)


def canonical_url(url: Column) -> Column:
    """Host in lower case, an empty path as /, no fragment; scheme and www. are kept, as each is a request of its own. Empty unless http(s)."""
    path = F.when(_part(url, 3) == "", "/").otherwise(_part(url, 3))
    query = F.when(F.length(_part(url, 4)) > 1, _part(url, 4)).otherwise("")
    return F.when(F.lower(_part(url, 1)).isin("http", "https"), F.concat(F.lower(_part(url, 1)), F.lit("://"), F.lower(_part(url, 2)), path, query)).otherwise("")


def safe_url(url: Column) -> Column:
    """A public web origin on an ordinary port, its path quoted; empty for addresses, local hosts, user information and white space."""
    port = F.regexp_extract(_part(url, 2), r":(\d+)$", 1)
    name = bare_host(url)
    public = F.contains(name, F.lit(".")) & ~name.rlike(r"^[\d.]+$") & ~name.rlike(r"\.(?:local|localhost)$")
    clean = canonical_url(url)
    quoted = F.concat(F.regexp_extract(clean, r"^([^:]+://[^/]*)", 1), _escaped(_part(clean, 3), _KEPT_IN_PATH), _part(clean, 4))
    return F.when(valid_url(url) & public & port.isin("", "80", "443"), quoted).otherwise("")


def safe_link(url: Column) -> Column:
    """The canonical URL with its path quoted."""
    clean = canonical_url(url)
    return F.concat(F.regexp_extract(clean, r"^([^:]+://[^/]*)", 1), _escaped(_part(clean, 3), _KEPT_IN_PATH), _part(clean, 4))


def _without_index(text: Column) -> Column:
    for page in ("/index.html", "/index.htm", "/index.php"):
        text = F.replace(text, F.lit(page), F.lit(""))
    return text


def loose_key(url: Column) -> Column:
    """No scheme, www., query, fragment, last slash or index page, in lower case: for reports, where variants are one row."""
    text = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"(?s)[#?].*$", "")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "/+$", ""), "^https?://", ""), r"^www\.", "")
    return _without_index(text)


def page_key(url: Column) -> Column:
    """No fragment, last slash or index page, in lower case; scheme, www. and query are kept."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "(?s)#.*$", ""), "/+$", ""), r"(?i)/index\.html?$", ""))


LAB_TOKEN = (
    r"(?i)(^|[^a-z])lab(orator(?:y|ies))?([^a-z]|$)|research[-_\s]?group|research[-_\s]?lab|"
    r"\b(center|centre|core|clinic|studio|observatory|institute|facility|collaborative)\b"
)


def unwrapped(url: Column) -> Column:
    """The address inside a mail gateway's rewritten link (between double underscores)."""
    inner = F.regexp_extract(url, "__([^_]+)__", 1)
    fixed = F.regexp_replace(inner, "^([^:]*):/(?!/)", "$1://")
    return F.when(F.contains(url, F.lit("urldefense.com")) & (inner != ""), fixed).otherwise(url)


def site_key(url: Column) -> Column:
    """The loose key of an unwrapped link; a host that names a laboratory stands for all its pages."""
    key = loose_key(F.trim(unwrapped(url)))
    name = F.split_part(key, F.lit("/"), F.lit(1))
    return F.when(name.rlike(LAB_TOKEN), name).otherwise(key)


def candidate_url(url: Column) -> Column:
    """Runs of slashes in the path as one, no last slash, query or fragment."""
    path = F.regexp_replace(_part(url, 3), "/{2,}", "/")
    path = F.when(path.isin("", "/"), path).otherwise(F.regexp_replace(path, "/+$", ""))
    return F.concat(F.lower(_part(url, 1)), F.lit("://"), _part(url, 2), path)


def homepage_key(url: Column) -> Column:
    """The URL key in which /home and the root are the same; for review, no proof of one entity."""
    path = F.regexp_replace(_part(url, 3), "/+$", "")
    path = F.when(F.endswith(path, F.lit("/home")), F.regexp_replace(path, "/home$", "")).otherwise(path)
    return url_key(F.concat(_part(url, 1), F.lit("://"), _part(url, 2), path, _part(url, 4)))


def content_key(url: Column) -> Column:
    """struct(host without www., path without last slash, query) of pages whose content may be reused; null unless http(s) with a host."""
    path = F.regexp_replace(_part(url, 3), "/+$", "")
    key = F.struct(F.regexp_replace(bare_host(url), r"^www\.", "").alias("host"), F.when(path == "", "/").otherwise(path).alias("path"), F.substr(_part(url, 4), F.lit(2)).alias("query"))
    return F.when(F.lower(_part(url, 1)).isin("http", "https") & (bare_host(url) != ""), key)


def request_key(url: Column) -> Column:
    """struct(scheme, host, port, quoted path, query) of an actual request; null for what no request can be made to."""
    path = F.when(_part(url, 3) == "", "/").otherwise(_escaped(_part(url, 3), _KEPT_IN_PATH))
    escapes = F.array_join(F.transform(F.regexp_extract_all(path, F.lit("%[0-9a-fA-F]{2}|[^%]+|%"), F.lit(0)), lambda r: F.when(r.rlike("^%.."), F.upper(r)).otherwise(r)), "")
    key = F.struct(
        F.lower(_part(url, 1)).alias("scheme"), bare_host(url).alias("host"), F.regexp_extract(_part(url, 2), r":(\d+)$", 1).alias("port"),
        escapes.alias("path"), F.substr(_part(url, 4), F.lit(2)).alias("query"),
    )
    return F.when(valid_url(url), key)


def _idna(names: pd.Series) -> pd.Series:
    def one(name: str | None) -> str | None:
        try:
            return name.rstrip(".").encode("idna").decode("ascii").lower() if name else None
        except UnicodeError:
            return None

    return names.map(one)


def host_name(url_or_host: Column) -> Column:
    """Host as it goes over the wire. Only names with other characters than ASCII need Python."""
    name = F.when(F.contains(url_or_host, F.lit("://")), bare_host(url_or_host)).otherwise(F.lower(F.regexp_extract(url_or_host, "^([^:/?#]*)", 1)))
    plain = F.regexp_replace(F.nullif(name, F.lit("")), r"\.+$", "")
    return F.when(plain.rlike(r"^[\x00-\x7F]*$"), plain).otherwise(F.pandas_udf(_idna, StringType())(F.when(~plain.rlike(r"^[\x00-\x7F]*$"), plain)))


def query_value(url: Column, name: str) -> Column:
    """The first value of a query parameter, decoded; null without one."""
    found = F.regexp_extract(F.concat(F.lit("&"), F.substr(_part(url, 4), F.lit(2))), f"&{name}=([^&]*)", 1)
    return F.nullif(decoded(F.replace(found, F.lit("+"), F.lit(" "))), F.lit(""))


# Hosts and paths that tell what a URL leads to.
NEWS_PATH = r"(?i)/(?:news|newsroom|news-releases?|press-releases?)(?:/|$|\.(?:html?|aspx)$)"
PUBLICATION_HOSTS = (
    "doi.org", "arxiv.org", "pubmed.ncbi.nlm.nih.gov", "ncbi.nlm.nih.gov", "scholar.google.com", "sciencedirect.com", "nature.com", "springer.com", "springerlink.com",
    "tandfonline.com", "wiley.com", "sagepub.com", "acm.org", "ieee.org", "jstor.org", "researchgate.net", "semanticscholar.org", "mitpress.mit.edu", "press.princeton.edu",
    "amazon.com", "cambridge.org", "oup.com",
)
PERSONAL_HOSTS = ("facebook.com", "instagram.com", "linkedin.com", "scholar.google.com", "twitter.com", "vimeo.com", "x.com", "youtube.com")
SHORTENERS = ("bit.ly", "t.co", "tinyurl.com")
LOGIN_HOSTS = ("accounts.google.com", "login.microsoftonline.com")
DOCUMENT_PATH = r"\.(?:pdf|docx?|pptx?|bib)(?:$|/)|/(?:doi|articles?|publications?|papers?|pubs|books?|catalog|search)(?:/|\.|$)"
LOGIN_PATH = r"(?i)/(?:login|signin|sign-in|sso|saml|oauth2?|authorize|shibboleth)(?:[/.?]|$)"
EXCLUDED_PATH = (
    r"(?i)/(?:about|admissions?|alumni|calendar|careers?|contact|divisions?|education|events?|give|giving|industry|jobs|news|privacy|recruitment|search|"
    r"teaching-laboratories|terms)(?:/|$)"
)
BRANDING_PATH = "/(?:visual-identity|branding|brand-guidelines|logo|style-guide)(?:/|$)"


def within_any(name: Column, domains: tuple[str, ...]) -> Column:
    """Whether a host is one of the domains or below one."""
    return name.isin(*domains) | name.rlike(r"\.(?:" + "|".join(d.replace(".", r"\.") for d in domains) + ")$") if domains else F.lit(False)


def destination_reason(url: Column, news_hosts: tuple[str, ...] = ()) -> Column:
    """Why a URL cannot be a laboratory's site: malformed, embedded_scheme or news; empty if nothing speaks against it."""
    path = F.lower(decoded(_part(url, 3)))
    name = F.regexp_replace(bare_host(url), r"\.$", "")
    return (
        F.when(~F.coalesce(valid_url(url), F.lit(False)) | url.rlike(r"[\s\x00-\x1f\x7f]"), "malformed").when(F.contains(path, F.lit("://")), "embedded_scheme")
        .when(within_any(name, news_hosts) | path.rlike(NEWS_PATH), "news").otherwise("")
    )


def nonlab_reason(name: Column, url: Column, news_hosts: tuple[str, ...] = ()) -> Column:
    """Why a pair of name and URL is no laboratory: a generic page's name, a publication, or the destination's reason."""
    generic = F.lower(F.trim(F.coalesce(name, F.lit("")))).isin("lab staff", "lab awards", "lab publications", "our publications")
    paper = F.coalesce(url, F.lit("")).rlike(r"(?i)doi\.org/|\.pdf(?:$|[?#])|/publications?(?:[/.?#]|$)|people/lab-staff")
    return F.when(generic, "generic_page").when(paper, "publication").otherwise(destination_reason(encode_url(url), news_hosts))


def is_lab_destination(url: Column, catalogue_hosts: tuple[str, ...] = (), news_hosts: tuple[str, ...] = ()) -> Column:
    """Whether a URL may be a laboratory's site: no news, publisher, document, shortener or catalogue."""
    name, path = bare_host(url), F.lower(decoded(_part(url, 3)))
    bad = name.isin(*catalogue_hosts) if catalogue_hosts else F.lit(False)
    bad = bad | within_any(name, PUBLICATION_HOSTS) | F.contains(name, F.lit("urldefense")) | name.isin(*SHORTENERS) | path.rlike(DOCUMENT_PATH)
    bad = bad | _part(url, 4).rlike("(?i)(?:format|type)=pdf|(?:searchfor|searchtype)=")
    return (destination_reason(url, news_hosts) == "") & ~bad


def authentication_target(url: Column, login_hosts: tuple[str, ...] = LOGIN_HOSTS) -> Column:
    return bare_host(url).isin(*login_hosts) | _part(url, 3).rlike(LOGIN_PATH)


def lab_link_allowed(url: Column, lab_like: Column) -> Column:
    """http(s), no social site, and no page of an institution's furniture unless the label speaks of a laboratory."""
    name = F.regexp_replace(F.lower(_part(url, 2)), r"^www\.", "")
    return F.lower(_part(url, 1)).isin("http", "https") & ~within_any(name, PERSONAL_HOSTS) & (lab_like | ~_part(url, 3).rlike(EXCLUDED_PATH))


def generic_external_reason(url: Column) -> Column:
    """branding or funder for outside pages that identify no laboratory; null otherwise."""
    path = F.lower(decoded(_part(url, 3)))
    return F.when(path.rlike(BRANDING_PATH), "branding").when(F.endswith(bare_host(url), F.lit("nih.gov")) & path.rlike("research-funded|research-initiatives|funding|grants"), "funder")


def scholar_profile(url: Column) -> Column:
    """Whether a URL is a citation profile that names its user."""
    user = query_value(url, "user")
    return F.coalesce(bare_host(url).rlike(r"^scholar\.google\.[a-z.]+$") & (_part(url, 3) == "/citations") & user.isNotNull(), F.lit(False))


def individual_profile(url: Column, campus: str, excluded_hosts: tuple[str, ...] = ()) -> Column:
    """Whether a campus page is one person's: a profile path with a leaf, or a page below people or faculty that is no listing."""
    name, path = bare_host(url), F.regexp_replace(_part(url, 3), "/+$", "")
    profile = path.rlike(r"/(?:people/)?profiles?/[^/]+$|/faculty-profiles/[^/]+$|/profile$|/faculty_bios/index\.sfe$")
    named = ~path.rlike(r"(?:/profile|/index\.sfe)$") | (F.length(_part(url, 4)) > 1)
    leaf = F.split_part(F.lower(F.regexp_extract(path, "([^/]*)$", 1)), F.lit("."), F.lit(1))
    generic = leaf.isin(
        "", "index", "faculty", "faculty-members", "faculty-profiles", "emeritus", "emeriti", "emeritus-faculty", "emeriti-faculty", "professors", "affiliated", "affiliate-faculty",
        "faculty-bios", "faculty_bios",
    )
    inside = F.endswith(name, F.lit(campus)) & (~name.isin(*excluded_hosts) if excluded_hosts else F.lit(True))
    return F.coalesce(inside & F.when(profile, named).otherwise(~generic & path.rlike("/people/|/faculty/")), F.lit(False))


def profile_identity(url: Column, campus: str, record_hosts: tuple[str, ...] = (), parameters: tuple[str, ...] = ("id",)) -> Column:
    """Key of one person's page: on hosts whose pages differ by a record id, that id; else the canonical URL of an individual page; else empty."""
    clean = canonical_url(url)
    record = F.coalesce(*[query_value(clean, p) for p in parameters])
    own = F.when(bare_host(clean).isin(*record_hosts) & record.isNotNull(), F.concat(F.lit("record:"), record)) if record_hosts else F.lit(None).cast("string")
    return F.coalesce(own, F.when(individual_profile(clean, campus), clean).otherwise(""))


def inside(root: Column, target: Column) -> Column:
    """Whether the target is the root's page or below its path, on the same host."""
    path = F.regexp_replace(_part(root, 3), "/+$", "")
    return (bare_host(root) == bare_host(target)) & ((F.regexp_replace(_part(target, 3), "/+$", "") == path) | F.startswith(_part(target, 3), F.concat(path, F.lit("/"))))


def title_of(url: Column) -> Column:
    """The last part of the path as words: hyphens and underscores are spaces, small words are capitalised."""
    leaf = decoded(F.regexp_extract(F.regexp_replace(_part(url, 3), "/+$", ""), "([^/]*)$", 1))
    words = F.filter(F.split(leaf, "[-_]+"), lambda w: w != "")
    return F.trim(F.regexp_replace(F.array_join(F.transform(words, lambda w: F.when((F.lower(w) == w) & (F.upper(w) != w), F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))).otherwise(w)), " "), r"\s+", " "))


def looks_like_profile(url: Column, name: Column) -> Column:
    """Whether the path is a profile's by its form or by the person's name in it; listings by kind of appointment are none."""
    from quarry.functions.names import slug

    path = decoded(_part(url, 3))
    listing = path.rlike("(?i)/(?:faculty|people/faculty)/(?:adjunct|affiliated|emeritus|teaching|visiting|lecturers?|researchers?)/?$")
    formed = path.rlike("(?i)(?:/people/profile/|/faculty/profile|/faculty-directory/|/faculty_bios/|/profiles/[^/]+|/people/faculty/[^/]+|/research/faculty/[^/]+|/faculty/Pages/[^/]+)")
    below = F.concat(path, F.lit("/")).rlike("(?i)/(?:people|faculty|faculty-directory|profile|profiles)/")
    person, leaf = slug(name), F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1)
    last = slug(leaf)
    parts = F.filter(F.split(person, "-"), lambda p: F.length(p) > 1)
    told = F.contains(slug(path), person) | ((F.length(last) >= 2) & F.endswith(person, last)) | ((F.size(parts) >= 2) & F.forall(parts, lambda p: F.contains(last, p)))
    return ~listing & (formed | (below & told))


def host(url: Column) -> Column:
    """Host in lower case without port; null if the URL is invalid."""
    return F.when(valid_url(url), F.lower(F.regexp_extract(_part(url, 2), r"^([^:]*)", 1)))


def host_within(url: Column, domain: str) -> Column:
    """Whether the host is the domain or below it."""
    return F.coalesce((host(url) == domain) | F.endswith(host(url), F.lit("." + domain)), F.lit(False))
