"""URL, HTML and date expressions, and the source-scoring rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P
from .text import blank, collapse_space, has_any, let, normalize_space, strip, unescape, words

URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?$"


def url_part(url: Column, part: str) -> Column:
    group = {"scheme": 1, "netloc": 2, "path": 3, "query": 4, "fragment": 5}[part]
    return F.regexp_extract(blank(url), URL, group)


def host_of(url: Column) -> Column:
    return F.lower(url_part(url, "netloc"))


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _unsplit(scheme: Column, netloc: Column, path: Column, query: Column) -> Column:
    return F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
                    F.when(netloc != "", F.concat(F.lit("//"), netloc)).otherwise(F.lit("")),
                    path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def canonicalize_url_keep_query(url: Column) -> Column:
    return let(strip(blank(url)), lambda u: let(
        F.struct(F.lower(url_part(u, "scheme")).alias("s"), host_of(u).alias("h"),
                 F.regexp_replace(url_part(u, "path"), "/{2,}", "/").alias("p"), url_part(u, "query").alias("q")),
        lambda r: _unsplit(r["s"], r["h"], r["p"], r["q"])))


def _kept_query(query: Column) -> Column:
    pairs = F.filter(F.split(query, "&"), lambda x: x != "")
    named = F.transform(pairs, lambda x: F.struct(
        _decode(F.substring_index(x, "=", 1)).alias("k"),
        _decode(F.when(F.instr(x, "=") > 0, F.substr(x, F.instr(x, "=") + 1)).otherwise(F.lit(""))).alias("v")))
    kept = F.filter(named, lambda p: ~F.lower(p["k"]).rlike("^(" + "|".join(P.DROPPED_QUERY_PREFIXES) + ")"))
    return F.array_join(F.transform(kept, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")


def canonicalize_url(url: Column) -> Column:
    """Registry-independent identity of a URL; tracking parameters are dropped."""
    return let(strip(blank(url)), lambda u: let(
        F.struct(F.lower(url_part(u, "scheme")).alias("s"), host_of(u).alias("h"),
                 F.regexp_replace(url_part(u, "path"), "/{2,}", "/").alias("p"),
                 _kept_query(url_part(u, "query")).alias("q")),
        lambda r: _unsplit(r["s"], r["h"], r["p"], r["q"])))


def supported_url(url: Column) -> Column:
    endings = "(" + "|".join(e.replace(".", r"\.") for e in P.EXCLUDED_EXTENSIONS) + ")$"
    return let(blank(url), lambda u: u.rlike("^https?://") & ~has_any(u, P.EXCLUDED_URL_PARTS, True)
               & ~url_part(F.lower(u), "path").rlike(endings))


def result_url(url: Column, anchor: Column) -> Column:
    host = host_of(url)
    words_in = F.lower(F.concat_ws(" ", blank(url), blank(anchor)))
    return supported_url(url) & (host != "") & ~host.isin(P.SEARCH_HOSTS) & ~has_any(words_in, P.LOGIN_WORDS)


def title_from_url(url: Column) -> Column:
    path = F.regexp_replace(url_part(url, "path"), "/+$", "")
    name = let(F.element_at(F.split(path, "/"), -1), lambda n: F.when(n == "", host_of(url)).otherwise(n))
    # A plus sign stays a plus sign in a path.
    decoded = _decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    return normalize_space(F.regexp_replace(decoded, "[_-]+", " "))


def content_kind(content_type: Column, url: Column) -> Column:
    def kind(low, path):
        last = F.element_at(F.split(path, "/"), -1)
        return (F.when(F.contains(low, F.lit("pdf")) | path.endswith(".pdf"), "pdf")
                .when(F.contains(low, F.lit("wordprocessingml")) | path.rlike(r"\.docx?$"), "docx")
                .when(F.contains(low, F.lit("html")) | path.rlike(r"\.(htm|html|shtml)$")
                      | ~F.contains(last, F.lit(".")), "html")
                .when(F.contains(low, F.lit("json")), "json")
                .when(F.contains(low, F.lit("csv")) | path.endswith(".csv"), "csv")
                .otherwise("other"))
    return let(F.struct(F.lower(blank(content_type)).alias("t"), url_part(F.lower(blank(url)), "path").alias("p")),
               lambda v: kind(v["t"], v["p"]))


def _without_dots(path: Column) -> Column:
    """Path with ``.`` and ``..`` segments resolved."""
    kept = let(F.split(path, "/"), lambda ps: F.aggregate(
        F.slice(ps, 2, F.greatest(F.size(ps) - 1, F.lit(0))), F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc).otherwise(F.array_append(acc, s))))
    closing = F.when(path.rlike(r"/\.{1,2}$"), "/").otherwise("")
    return F.regexp_replace(F.concat(F.lit("/"), F.array_join(kept, "/"), closing), "^/+$", "/")


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute URL of a link found on a page."""
    def join(b, h):
        root = F.concat(b["s"], F.lit("://"), b["n"])
        own = url_part(h, "path")
        tail = F.substr(h, F.length(own) + 1)
        folder = F.regexp_replace(b["p"], "[^/]*$", "")
        merged = F.when(own.startswith("/"), own).otherwise(
            F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), own))
        return (F.when(h == "", b["u"])
                .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
                .when(h.startswith("//"), F.concat(b["s"], F.lit(":"), h))
                .when(h.startswith("?"), F.concat(root, b["p"], h))
                .when(h.startswith("#"), F.concat(F.substring_index(b["u"], "#", 1), h))
                .otherwise(F.concat(root, let(merged, _without_dots), tail)))
    parts = F.struct(blank(base).alias("u"), url_part(base, "scheme").alias("s"),
                     url_part(base, "netloc").alias("n"), url_part(base, "path").alias("p"))
    return let(F.struct(parts.alias("b"), strip(blank(href)).alias("h")), lambda v: join(v["b"], v["h"]))


# ---- HTML -----------------------------------------------------------------------

TAG = r"(?s)</?[A-Za-z](?:\"[^\"]*\"|'[^']*'|[^'\">]+)*+>|<[!?][^>]*>"
_HIDDEN = "\ue000"
_RAW_START = "\ue001"


def _visible(html: Column) -> Column:
    """Comments become breaks; ``<`` inside script and style bodies is masked."""
    no_comments = F.regexp_replace(blank(html), r"(?s)<!--.*?-->", "<!>")
    marked = F.regexp_replace(no_comments, r"(?i)(<(?:script|style)\b[^>]*>)", "$1" + _RAW_START)
    return F.array_join(F.transform(F.split(marked, _RAW_START), lambda p, i: F.when(
        (i == 0) | ~p.rlike(r"(?i)</(script|style)"), p).otherwise(F.concat(
            F.replace(F.regexp_extract(p, r"(?is)^(.*?)</(?:script|style)", 1), F.lit("<"), F.lit(_HIDDEN)),
            F.regexp_replace(p, r"(?is)^.*?(?=</(?:script|style))", "")))), "")


def _chunks(markup: Column) -> Column:
    """Non-empty, space-normalised text pieces between tags."""
    pieces = F.split(markup, TAG)
    plain = F.transform(pieces, lambda p: normalize_space(F.replace(p, F.lit(_HIDDEN), F.lit("<"))))
    return F.filter(plain, lambda p: p != "")


def visible_text(visible: Column) -> Column:
    """Whole text of a page."""
    return F.array_join(_chunks(visible), " ")


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute inside a tag, entities resolved; null if absent."""
    pattern = rf"(?is)(?:^|[\s\"'/]){name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    found = F.concat(*[F.regexp_extract(tag, pattern, g) for g in (1, 2, 3)])
    return F.when(tag.rlike(pattern), unescape(found))


def meta_tags(visible: Column) -> Column:
    """(key, value) of each meta tag, in page order."""
    tags = F.regexp_extract_all(visible, F.lit(
        r"(?is)<meta\b((?:\"[^\"]*\"|'[^']*'|[^'\">]+)*+)>"), F.lit(1))
    first = lambda t: F.coalesce(
        *[F.nullif(attribute(t, a), F.lit("")) for a in ("name", "property", "http-equiv")], F.lit(""))
    pairs = F.transform(tags, lambda t: F.struct(
        F.lower(strip(first(t))).alias("key"), strip(blank(attribute(t, "content"))).alias("value")))
    return F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != ""))


def first_meta(metas: Column, keys: list[str]) -> Column:
    """Value of the first key that has one; the last tag of a key counts."""
    ranked = F.filter(F.transform(words(keys), lambda k: F.try_element_at(
        F.filter(metas, lambda m: m["key"] == k), F.lit(-1))["value"]), lambda v: v.isNotNull())
    return F.coalesce(F.get(ranked, F.lit(0)), F.lit(""))


def html_title(visible: Column) -> Column:
    bodies = F.regexp_extract_all(visible, F.lit(r"(?is)<title\b[^>]*>(.*?)</title\s*>"), F.lit(1))
    return collapse_space(F.array_join(F.flatten(F.transform(bodies, _chunks)), " "))


def page_links(visible: Column) -> Column:
    """(href, anchor) of each closed link, in page order."""
    opened = let(F.split(visible, r"(?i)<a(?=[\s>])"), lambda ps: F.slice(
        ps, 2, F.greatest(F.size(ps) - 1, F.lit(0))))
    closed = F.filter(opened, lambda p: p.rlike(r"(?i)</a\s*>"))
    head = r"(?s)^((?:\"[^\"]*\"|'[^']*'|[^'\">]+)*+)>"
    links = F.transform(closed, lambda p: F.struct(
        attribute(F.regexp_extract(p, head, 1), "href").alias("href"),
        collapse_space(F.array_join(_chunks(F.regexp_extract(
            F.regexp_replace(p, head, ""), r"(?is)^(.*?)</a\s*>", 1)), " ")).alias("anchor")))
    return F.filter(links, lambda x: blank(x["href"]) != "")


def page_metadata(html: Column) -> Column:
    """Struct of title, description, meta pairs and visible text of a page."""
    def build(v):
        return let(meta_tags(v), lambda metas: F.struct(
            let(first_meta(metas, P.TITLE_META_KEYS), lambda named: normalize_space(
                F.when(named != "", named).otherwise(html_title(v)))).alias("title"),
            normalize_space(first_meta(metas, P.DESCRIPTION_META_KEYS)).alias("description"),
            metas.alias("meta"), visible_text(v).alias("text")))
    return let(_visible(html), build)


def _link_target(u: Column) -> Column:
    found = F.regexp_extract(url_part(u, "query"), "(?:^|&)uddg=([^&]+)", 1)
    return F.when(F.contains(u, F.lit("uddg=")) & (found != ""), _decode(found)).otherwise(u)


def extract_links(html: Column, base_url: Column) -> Column:
    """Distinct supported links of a page as (url, anchor); the first anchor wins."""
    usable = F.filter(page_links(_visible(html)), lambda x: ~strip(x["href"]).rlike("^(javascript:|mailto:|tel:|$)"))
    absolute = F.transform(usable, lambda x: F.struct(
        let(resolve_url(base_url, x["href"]), _link_target).alias("url"), x["anchor"].alias("anchor")))
    good = F.transform(F.filter(absolute, lambda x: supported_url(x["url"])), lambda x: F.struct(
        canonicalize_url(x["url"]).alias("url"), x["anchor"].alias("anchor")))
    return let(good, lambda g: let(F.transform(g, lambda x: x["url"]), lambda urls: F.filter(
        g, lambda x, i: F.array_position(urls, x["url"]) == i + 1)))


# ---- dates ----------------------------------------------------------------------

def _valid_date(y: Column, m: Column, d: Column) -> Column:
    text = F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd")


def _dateish(t: Column) -> Column:
    full = r"(20\d{2})[-/.年](\d{1,2})[-/.月](\d{1,2})日?"
    tight = r"(20\d{2})(\d{2})(\d{2})"
    tagged = r"t(20\d{2})(\d{2})(\d{2})"
    month = r"(20\d{2})[-/.年](\d{1,2})"
    g = lambda p, i: F.regexp_extract(t, p, i)
    dates = [F.when(g(p, 1) != "", _valid_date(g(p, 1), g(p, 2), g(p, 3))) for p in (full, tight, tagged)]
    ym = F.when((g(month, 1) != "") & g(month, 2).try_cast("int").between(1, 12),
                F.concat(g(month, 1), F.lit("-"), F.lpad(g(month, 2), 2, "0")))
    return F.when(F.contains(t, F.lit("20")), F.coalesce(*dates, ym, g(r"(20\d{2})", 1))).otherwise("")


def parse_dateish(text: Column) -> Column:
    """Full date, else year-month, else year, else empty."""
    return let(blank(text), _dateish)


def published_date(metas: Column, title: Column, description: Column, url: Column, raw: Column) -> Column:
    tried = F.transform(words(P.DATE_META_KEYS), lambda k: parse_dateish(F.try_element_at(
        F.filter(metas, lambda m: m["key"] == k), F.lit(-1))["value"]))
    hay = F.concat_ws(" ", blank(title), blank(description), blank(url), blank(raw))
    return F.coalesce(F.get(F.filter(tried, lambda d: d != ""), F.lit(0)), parse_dateish(hay))


# ---- scoring --------------------------------------------------------------------

def _official(host: Column) -> Column:
    suffix = F.lit(False)
    for s in P.OFFICIAL_SUFFIXES:
        suffix = suffix | host.endswith(s)
    return host.isin(P.OFFICIAL_HOSTS) | suffix


def classify_authority(url: Column, title: Column, text: Column) -> Column:
    def decide(v):
        host = v["host"]
        title_hay = F.lower(F.concat_ws(" ", v["main"], v["url"]))
        formal = has_any(title_hay, P.FORMAL_DOC_TERMS, True) | (
            F.contains(v["hay"], F.lit(P.GAZETTE_WORD)) & has_any(v["hay"], P.GAZETTE_COMPANIONS))
        login = F.contains(v["hay"], F.lit("ssologin")) | F.contains(v["title"], F.lit(P.LOGIN_TITLE_WORD))
        return (F.when(login, "X")
                .when(host.isin(P.INTERNATIONAL_HOSTS), "A3")
                .when(host.isin(P.MEDIA_HOSTS), "A2")
                .when(_official(host) & ((host == P.OPEN_DATA_HOST) | formal), "A0")
                .when(_official(host) | host.endswith(".edu.cn"), "A1")
                .otherwise("A2"))
    main = F.element_at(F.split(blank(title), r"[_|｜]", 2), 1)
    return let(F.struct(
        host_of(url).alias("host"), blank(url).alias("url"), blank(title).alias("title"), main.alias("main"),
        F.lower(F.concat_ws(" ", main, blank(text), blank(url))).alias("hay")), decide)


def classify_recency(published: Column, title: Column, text: Column, year: int) -> Column:
    y = F.nullif(F.regexp_extract(blank(published), r"^(20\d{2})", 1), F.lit("")).cast("int")
    hay = F.lower(F.concat_ws(" ", blank(title), blank(text)))
    return (F.when(y >= year, "T0").when(y == year - 1, "T1")
            .when(has_any(hay, P.PLAN_PERIOD_WORDS), "T2")
            .when(has_any(hay, P.HERITAGE_WORDS), "T3").otherwise("T4"))


def topic_hits(title: Column, text: Column, url: Column, terms: list[str] | None = None) -> Column:
    hay = F.replace(F.lower(F.concat_ws(" ", blank(title), blank(text), blank(url))),
                    F.lit(" "), F.lit(""))
    listed = terms if terms is not None else P.TOPIC_TERMS
    found = let(hay, lambda h: F.filter(words(listed), lambda t: F.contains(
        h, F.replace(F.lower(t), F.lit(" "), F.lit("")))))
    return F.array_sort(F.array_distinct(found))


def _points(c: Column, table: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, value in table.items():
        out = F.when(c == name, value).otherwise(out)
    return out


def score_candidate(url: Column, title: Column, text: Column, published: Column, content_type: Column,
                    year: int, terms: list[str] | None = None) -> Column:
    """Struct of score 0..100, authority, recency, topic hits and notes."""
    formal = has_any(F.concat_ws(" ", blank(title), blank(url)), P.FORMAL_DOC_TERMS, True)
    draft = F.contains(blank(title), F.lit(P.CONSULTATION_WORD)) | F.contains(blank(text), F.lit(P.CONSULTATION_WORD))

    def total(v):
        unrelated = (F.size(v["found"]) == 0) & ~v["authority"].isin("A0", "A3")
        score = (_points(v["authority"], P.AUTHORITY_POINTS) + _points(v["recency"], P.RECENCY_POINTS)
                 + F.least(F.lit(28), F.size(v["found"]) * 4)
                 + F.when(v["kind"].isin("pdf", "docx", "csv", "json"), 5).otherwise(0)
                 + F.when(v["formal"], 6).otherwise(0) - F.when(v["draft"], 8).otherwise(0)
                 - F.when(unrelated, 12).otherwise(0))
        notes = F.array_compact(F.array(F.when(v["draft"], "draft_or_consultation"),
                                        F.when(v["authority"] == "X", "excluded_or_login"),
                                        F.when(unrelated, "low_topic_match")))
        return F.struct(F.greatest(F.lit(0), F.least(F.lit(100), score)).alias("score"),
                        v["authority"].alias("authority"), v["recency"].alias("recency"),
                        v["found"].alias("topic_hits"), F.array_join(notes, ";").alias("notes"))
    return let(F.struct(
        classify_authority(url, title, text).alias("authority"),
        classify_recency(published, title, text, year).alias("recency"),
        topic_hits(title, text, url, terms).alias("found"), content_kind(content_type, url).alias("kind"),
        draft.alias("draft"), formal.alias("formal")), total)


def review_bucket(score: Column) -> Column:
    return (F.when(score >= 75, "core_review").when(score >= 55, "secondary_review")
            .when(score >= 35, "background").otherwise("low_priority"))


def link_relevance(url: Column, anchor: Column, terms: list[str] | None = None) -> Column:
    both = F.concat_ws(" ", blank(anchor), blank(url))
    return (F.size(topic_hits(anchor, F.lit(""), url, terms)) * 6
            + F.when(_official(host_of(url)), 12).otherwise(0)
            + F.when(has_any(both, P.FORMAL_DOC_TERMS), 8).otherwise(0)
            + F.when(both.rlike("20(25|26)"), 5).otherwise(0))


# ---- registry drafts ---------------------------------------------------------------

def normalize_id(value: Column, url: Column) -> Column:
    base = F.upper(F.regexp_replace(F.regexp_replace(blank(value), "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))
    hashed = F.concat(F.lit("URL-"), F.upper(F.left(F.sha1(blank(url)), F.lit(10))))
    return F.concat(F.lit("DRAFT-"), let(base, lambda b: F.when(b == "", hashed).otherwise(b)))


def registry_file_type(row_type: Column, content_type: Column, url: Column) -> Column:
    t = F.lower(blank(row_type))
    kind = content_kind(content_type, url)
    return (F.when(F.contains(t, F.lit("pdf")), "pdf").when(F.contains(t, F.lit("doc")), "docx")
            .when(F.contains(t, F.lit("csv")), "csv")
            .when(F.contains(t, F.lit("geo")) | (t == "metadata_html"), "webpage")
            .when(kind == "other", "webpage").otherwise(kind))


def registry_source_kind(authority: Column, url: Column, title: Column, topic: Column, notes: Column) -> Column:
    hay = F.lower(F.concat_ws(" ", blank(title), blank(url), blank(topic), blank(notes)))
    return (F.when(has_any(hay, ["openstreetmap", "odbl"]), "open_license_reference")
            .when(authority == "A3", "international_reference")
            .when(authority == "A2", "media_report")
            .when(F.contains(blank(url), F.lit(P.OPEN_DATA_HOST)) | has_any(hay, ["open_data", P.CATALOGUE_WORD]),
                  "official_open_data")
            .when(has_any(title, P.STANDARD_TITLE_WORDS) | F.contains(hay, F.lit("standard")), "official_standard")
            .when(has_any(title, P.ANNOUNCEMENT_TITLE_WORDS), "official_announcement")
            .when(authority.isin("A0", "A1"), "official_news").otherwise("media_report"))


def registry_access(row_type: Column, notes: Column, url: Column) -> Column:
    hay = F.lower(F.concat_ws(" ", blank(row_type), blank(notes), blank(url)))
    return F.when(has_any(hay, P.RESTRICTED_WORDS), "restricted_or_unknown").otherwise("public_url")


def registry_formal_use(authority: Column, access: Column) -> Column:
    return (F.when(access == "restricted_or_unknown", "no")
            .when(authority.isin("A0", "A1", "A3"), "background_only").otherwise("no"))


def registry_allowed_uses(topic: Column, authority: Column) -> Column:
    return F.array_compact(F.array(
        F.lit(P.DRAFT_ALLOWED), F.when(blank(topic) != "", F.concat(F.lit(P.DRAFT_ALLOWED_TOPIC), topic)),
        F.when(authority == "A0", F.lit(P.DRAFT_ALLOWED_A0))))


def registry_prohibited_uses(title: Column, notes: Column, access: Column) -> Column:
    draft = F.contains(F.concat_ws(" ", blank(title), blank(notes)), F.lit(P.CONSULTATION_WORD))
    return F.array_compact(F.array(
        *[F.lit(x) for x in P.DRAFT_PROHIBITED],
        F.when(access == "restricted_or_unknown", F.lit(P.DRAFT_PROHIBITED_RESTRICTED)),
        F.when(draft, F.lit(P.DRAFT_PROHIBITED_CONSULTATION))))
