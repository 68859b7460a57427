"""Checks on document text.  All of them work inside the row: no shuffle."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import text as X
from .rows import for_all, issue, list_issues, rule_rows


def _keywords(phrases: Sequence[str]) -> list[str]:
    return [k for p in phrases for k in (part.strip() for part in re.split("[、，,]", p)) if k]


def scan_forbidden(docs: DataFrame, key: str, text: str, phrases: Sequence[str]) -> DataFrame:
    """A hit per keyword with 20 characters before and 30 after it."""
    t = F.col(text)
    found = docs.select(key, text, F.explode(X.hits(t, _keywords(phrases))).alias("keyword"))
    at = F.instr(t, F.col("keyword"))
    start = F.greatest(at - 20, F.lit(1))
    end = F.least(F.length(t), at - 1 + F.length("keyword") + 30)
    context = X.strip(F.replace(F.substr(t, start, end - start + 1), F.lit("\n"), F.lit(" ")))
    return found.select(key, "keyword", context.alias("context"))


def scan_required(docs: DataFrame, key: str, text: str, phrases: Sequence[str]) -> DataFrame:
    missing, found = X.lacks(F.col(text), phrases), X.hits(F.col(text), phrases)
    return docs.select(key, F.when(F.size(missing) > 0, "FAIL").otherwise("PASS").alias("outcome"),
                       F.array_join(missing, ", ").alias("missing"), F.array_join(found, ", ").alias("found"))


def scan_exact(docs: DataFrame, key: str, text: str, phrases: Sequence[str], wording: str) -> DataFrame:
    return docs.select(key, F.array_join(X.hits(F.col(text), phrases), "|").alias("forbidden"),
                       F.contains(X.blank(F.col(text)), F.lit(wording)).alias("has_wording"))


def scan_concepts(docs: DataFrame, key: str, text: str, pairs=None, domain=None) -> DataFrame:
    """Concepts the text does not name; a domain word stands for all of them."""
    t = F.col(text)
    pairs, domain = pairs or P.CONCEPT_PAIRS, domain or P.CONCEPT_DOMAIN_WORDS
    unseen = F.array_compact(F.array(*[
        F.when(~(F.contains(X.blank(t), F.lit(first)) | F.contains(F.lower(X.blank(t)), F.lit(second.lower()))),
               F.lit(first)) for first, second in pairs]))
    covered = X.has_any(F.lower(X.blank(t)), domain)
    missing = F.when(covered, F.array().cast("array<string>")).otherwise(unseen)
    return docs.select(key, F.when(F.size(missing) > 0, "FAIL").otherwise("PASS").alias("outcome"),
                       F.array_join(missing, ", ").alias("missing"))


def check_documented(assumptions: DataFrame, key: str, entry: str, controls: Sequence[str],
                     submissions: DataFrame | None = None) -> DataFrame:
    """Controls that no assumption entry of the key names.

    One map-side combined flag per control, so no join and no hot key.
    """
    low = F.lower(X.blank(F.col(entry)))
    flags = [F.coalesce(F.bool_or(F.contains(low, F.lit(c.lower()))), F.lit(False)).alias(f"c{i}")
             for i, c in enumerate(controls)]
    seen = for_all(assumptions.groupBy(key).agg(*flags), submissions, key)
    gaps = F.array_compact(F.array(*[F.when(~F.col(f"c{i}"), F.lit(c)) for i, c in enumerate(controls)]))
    return seen.select(key, F.when(F.size(gaps) > 0, "FAIL").otherwise("PASS").alias("outcome"),
                       F.array_join(gaps, ", ").alias("uncovered"))


def check_authority(sources: DataFrame, key: str, source_id: str, row_text: str, ids: DataFrame,
                    terms: Sequence[str] | None = None) -> DataFrame:
    """Provisional sources whose row mentions a formal use (first such use)."""
    low = F.lower(X.blank(F.col(row_text)))
    first = F.try_element_at(X.hits(low, terms or P.FORMAL_FIELDS), F.lit(1))
    provisional = sources.join(ids.select(F.col(ids.columns[0]).alias(source_id)).distinct(), source_id, "left_semi")
    return provisional.select(key, source_id, first.alias("used_for")).filter("used_for IS NOT NULL")


def check_crs(docs: DataFrame, key: str, text: str, code: str = "4548") -> DataFrame:
    return docs.select(key, F.when(F.contains(X.blank(F.col(text)), F.lit(code)), "PASS").otherwise("FAIL").alias("outcome"))


def scan_patterns(docs: DataFrame, key: str, text: str, patterns, severity: str) -> DataFrame:
    reasons = X.pattern_hits(F.col(text), patterns)
    return docs.select(key, F.explode(reasons).alias("reason"), F.lit(severity).alias("severity"))


def scan_hard_risk(docs: DataFrame, key: str, text: str, patterns=None) -> DataFrame:
    return scan_patterns(docs, key, text, patterns or P.HARD_RISK_PATTERNS, "error")


def scan_soft_risk(docs: DataFrame, key: str, text: str, patterns=None) -> DataFrame:
    return scan_patterns(docs, key, text, patterns or P.SOFT_RISK_PATTERNS, "warning")


def scan_report_html(pages: DataFrame, key: str, html: str) -> DataFrame:
    h = X.blank(F.col(html))
    forbidden = F.transform(X.pattern_hits(h, P.REPORT_HTML_PATTERNS), lambda r: issue("REPORT_ACTIVE_CONTENT", r))
    figures = list_issues(X.lacks(h, ["../" + p for p in sorted(P.REQUIRED_IMAGES)]),
                          "REPORT_FIGURE_MISSING", lambda v: v)
    incomplete = ~F.contains(h, F.lit("<main")) | ~F.contains(h, F.lit("</html>"))
    return rule_rows(pages, [key], [(incomplete, "REPORT_INCOMPLETE", "not a complete HTML document")],
                     forbidden, figures)


def scan_visual_html(pages: DataFrame, key: str, html: str, markers: Sequence[str] | None = None) -> DataFrame:
    h = X.blank(F.col(html))
    plain = X.unescape(F.regexp_replace(F.regexp_replace(h, "<[^>]+>", " "), f"{X.WS}+", " "))
    forbidden = F.transform(X.pattern_hits(h, P.VISUAL_HTML_PATTERNS),
                            lambda r: issue("VISUAL_REMOTE_OR_ACTIVE_CONTENT", r, "blocking"))
    missing = list_issues(X.lacks(plain, markers or P.VISUAL_TEXT_MARKERS),
                          "VISUAL_REQUIRED_SECTION_MISSING", lambda v: v)
    return rule_rows(pages, [key], [], forbidden, missing)


def _titled(secs: Column, name: str) -> Column:
    return F.filter(secs, lambda s: F.contains(s["title"], F.lit(name)))


def check_sections(docs: DataFrame, key: str, text: str, required: Sequence[str],
                   min_section: int = P.MIN_SECTION_CHARS, min_body: int = P.MIN_BODY_CHARS) -> DataFrame:
    """Required headings, their longest body, and the length of the whole text."""
    df = docs.withColumn("__s", X.sections(F.col(text)))
    rules = [(X.compact_len(F.col(text)) < min_body, "BODY_TOO_SHORT", "")]
    for name in required:
        match = _titled(F.col("__s"), name)
        longest = F.array_max(F.transform(match, lambda s: X.compact_len(s["body"])))
        rules.append((F.size(match) == 0, "SECTION_MISSING", name))
        rules.append((longest < min_section, "SECTION_TOO_THIN", name))
    return rule_rows(df, [key], rules)


def section_min(docs: DataFrame, key: str, text: str, marker: str, n: int = 100) -> DataFrame:
    body = X.section_from_marker(F.col(text), marker)
    return docs.select(key, F.coalesce(F.length(body) >= n, F.lit(False)).alias("long_enough"))


def scan_boilerplate(docs: DataFrame, key: str, text: str, land_features: DataFrame | None = None,
                     phrases: Sequence[str] | None = None, operations: Sequence[str] | None = None) -> DataFrame:
    """Few headings, stock phrases, no operations topic, few land-use features."""
    t = X.blank(F.col(text))
    headings = F.regexp_count(F.concat(F.lit("\n"), t), F.lit("\n## "))
    stock = F.lit(0)
    for p in phrases or P.STOCK_PHRASES:
        stock = stock + F.regexp_count(t, F.lit(re.escape(p)))
    df = docs.withColumn("__n", F.lit(None).cast("bigint"))
    if land_features is not None:
        counted = land_features.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
        df = docs.join(counted, key, "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    return rule_rows(df, [key], [
        (headings < 8, "FEW_HEADINGS", headings.cast("string")),
        (stock > 5, "STOCK_PHRASES", stock.cast("string")),
        (~X.has_any(t, operations or P.OPERATIONS_WORDS), "OPERATIONS_MISSING", ""),
        (F.col("__n") <= 4, "FEW_LAND_USE_FEATURES", F.col("__n").cast("string"))])


def scan_placeholder(docs: DataFrame, key: str, text: str, statement: str,
                     markers: Sequence[str] | None = None, min_statement: int = 180) -> DataFrame:
    left = list_issues(X.hits(F.col(text), markers or P.SCAFFOLD_MARKERS), "PLACEHOLDER_MARKER", lambda v: v)
    short = F.length(X.strip(X.blank(F.col(statement)))) < min_statement
    return rule_rows(docs, [key], [
        (F.col(text).isNull(), "PROPOSAL_MISSING", ""),
        (F.col(statement).isNull(), "STATEMENT_MISSING", ""),
        (F.col(statement).isNotNull() & short, "STATEMENT_TOO_SHORT", "")], left)


def check_changelog(docs: DataFrame, key: str, text: str, title: str = P.CHANGELOG_TITLE) -> DataFrame:
    t = X.blank(F.col(text))
    dated = F.exists(F.transform(X._lines(t), X.strip), lambda x: x.rlike(P.CHANGELOG_HEADING_PATTERN))
    risky = F.transform(X.pattern_hits(t, P.HARD_RISK_PATTERNS), lambda r: issue("HARD_RISK", r, "error"))
    soft = F.transform(X.pattern_hits(t, P.SOFT_RISK_PATTERNS), lambda r: issue("SOFT_RISK", r, "warning"))
    return rule_rows(docs, [key], [
        (~F.contains(t, F.lit(title)), "CHANGELOG_TITLE", title, "error"),
        (~dated, "CHANGELOG_VERSION", "", "error"),
        (X.compact_len(t) < 80, "CHANGELOG_SHORT", "", "warning")], risky, soft)


def check_tags(docs: DataFrame, key: str, tags: str, known: DataFrame, limit: int,
               pattern: str = P.SLUG_PATTERN) -> DataFrame:
    """At most ``limit`` distinct, well-formed, known ids per document."""
    df = docs.withColumn("__t", X.parse_tag_list(F.col(tags)))
    whole = rule_rows(df, [key], [
        (F.size("__t") > limit, "TOO_MANY_TAGS", F.size("__t").cast("string")),
        (F.size(F.array_distinct("__t")) < F.size("__t"), "DUPLICATE_TAG", "")])
    single = df.select(key, F.explode("__t").alias("tag"))
    bad = single.filter(~F.col("tag").rlike(pattern)).select(
        key, F.lit("MALFORMED_TAG").alias("check_id"), F.lit("major").alias("severity"), F.col("tag").alias("detail"))
    ids = known.select(F.col(known.columns[0]).alias("tag")).distinct()
    unknown = single.filter(F.col("tag").rlike(pattern)).join(ids, "tag", "left_anti").select(
        key, F.lit("UNKNOWN_TAG").alias("check_id"), F.lit("major").alias("severity"), F.col("tag").alias("detail"))
    return whole.unionByName(bad).unionByName(unknown)


def normalize_image_path(raw: Column) -> Column:
    """Local path of an embedded image; null when it is remote or escapes."""
    clean = F.substring_index(F.substring_index(raw, "#", 1), "?", 1)
    remote = raw.rlike(r"(?i)^(?:https?:)?//") | raw.rlike(r"(?i)^(?:data|file|javascript):")
    unsafe = clean.startswith("/") | F.array_contains(F.split(clean, "/"), "..")
    return F.when(~remote & ~unsafe, F.regexp_replace(F.regexp_replace(clean, "/{2,}", "/"), r"^(\./)+", ""))


def check_images(docs: DataFrame, key: str, text: str, files: DataFrame,
                 required: Sequence[str] | None = None) -> DataFrame:
    """Embedded images must be local, under assets/, described and present."""
    required = sorted(required if required is not None else P.REQUIRED_IMAGES)
    df = docs.withColumn("__im", F.transform(X.extract_images(F.col(text)), lambda x: F.struct(
        x["alt"].alias("alt"), x["path"].alias("raw"), normalize_image_path(x["path"]).alias("path"))))
    present = F.transform(F.col("__im"), lambda x: x["path"])
    gaps = F.filter(X.words(required), lambda p: ~F.coalesce(F.array_contains(present, p), F.lit(False)))
    missing = rule_rows(df, [key], [], list_issues(gaps, "REQUIRED_IMAGE", lambda v: v))
    one = df.select(key, F.explode("__im").alias("im")).select(key, "im.*")
    ok_ext = F.lower(F.regexp_extract(F.col("path"), r"(\.[^./]*)$", 1)).isin(P.ASSET_EXTENSIONS)
    assets = F.coalesce(F.col("path").startswith("assets/"), F.lit(False))
    rows = rule_rows(one, [key], [
        (F.col("path").isNull(), "IMAGE_NOT_LOCAL", F.col("raw")),
        (F.col("path").isNotNull() & ~assets, "IMAGE_OUTSIDE_ASSETS", F.col("path")),
        (assets & ~ok_ext, "IMAGE_EXTENSION", F.col("path")),
        (assets & (F.length("alt") < 6), "IMAGE_ALT", F.col("path"))])
    known = files.select(key, F.col("path")).distinct()
    absent = one.filter(assets).join(known, [key, "path"], "left_anti").select(
        key, F.lit("IMAGE_MISSING").alias("check_id"), F.lit("major").alias("severity"), F.col("path").alias("detail"))
    return missing.unionByName(rows).unionByName(absent)


def check_front_matter(docs: DataFrame, key: str, text: str, required_sections: Sequence[str] | None = None,
                       min_chars: int = P.MIN_BODY_CHARS, min_section: int = P.MIN_SECTION_CHARS,
                       min_letters: int = P.MIN_ENGLISH_LETTERS) -> DataFrame:
    """Front-matter fields and, for English texts, the translation rules."""
    sections = P.REQUIRED_SECTIONS if required_sections is None else required_sections
    # Each part of the text is a column of its own, so it is found once however many rules read it.
    df = docs.select(key, text, F.inline(F.array(X.front_matter(F.col(text)))).alias("__meta", "__body"))
    meta, body = F.col("__meta"), F.col("__body")
    value = lambda k: X.blank(X.meta_value(meta, k))
    rules = [(value(k) == "", "FIELD_MISSING", k) for k in P.REQUIRED_METADATA]
    lang, english = value("language"), value("language") == "en"
    heading = "(?m)^" + re.escape(P.TRANSLATION_HEADING) + r"\s*$"
    df = df.select("*", F.inline(F.array(F.struct(F.when(english, F.split(body, heading, 2)).alias("__p")))))
    has_part = F.size("__p") > 1
    first, second = F.get("__p", F.lit(0)), F.coalesce(F.get("__p", F.lit(1)), F.lit(""))
    df = df.select("*", F.inline(F.array(F.struct(F.when(has_part, X.sections(second)).alias("__s")))))
    letters = F.length(first) - F.length(F.regexp_replace(first, "[A-Za-z]", ""))
    rules += [
        (F.contains(X.blank(F.col(text)), F.lit(P.SCAFFOLD_MARKERS[0])), "SCAFFOLD_MARKER", ""),
        (~lang.isin("", "zh", "en"), "LANGUAGE", lang),
        (english & (value("chinese_translation") != "included"), "TRANSLATION_FLAG", ""),
        (english & (value("title_zh") == ""), "FIELD_MISSING", "title_zh"),
        (english & (value("summary_zh") == ""), "FIELD_MISSING", "summary_zh"),
        (english & ~has_part, "TRANSLATION_MISSING", ""),
        (english & has_part & (X.compact_len(first) < min_chars), "ENGLISH_TOO_SHORT", "characters"),
        (english & has_part & (letters < min_letters), "ENGLISH_TOO_SHORT", "letters"),
        (english & has_part & (X.compact_len(second) < min_chars), "TRANSLATION_TOO_SHORT", ""),
        (~value("license").isin("", *P.LICENSES), "LICENSE", value("license"))]
    for k in ("iteration", "version"):
        rules.append(((value(k) != "") & ~value(k).rlike(P.VERSION_PATTERN), "VERSION_FORM", k))
    translated = F.col("__s")
    for name in sections:
        match = _titled(translated, name)
        some = english & has_part & (F.size(match) > 0)
        rules += [
            (english & has_part & (F.size(match) == 0), "TRANSLATION_SECTION_MISSING", name),
            (some & (F.array_max(F.transform(match, lambda s: X.compact_len(s["body"]))) < min_section),
             "TRANSLATION_SECTION_THIN", name),
            (some & ~F.exists(match, lambda s: s["body"].rlike(X.REFERENCE)), "TRANSLATION_SECTION_REFERENCE", name)]
    images = F.transform(X.extract_images(second), lambda x: F.substring_index(
        F.substring_index(x["path"], "#", 1), "?", 1))
    gaps = F.when(english & has_part, F.filter(
        X.words(sorted(P.REQUIRED_IMAGES)), lambda p: ~F.array_contains(images, p))).otherwise(
        F.array().cast("array<string>"))
    leftovers = list_issues(X.hits(F.col(text), P.TEMPLATE_PLACEHOLDERS), "TEMPLATE_PLACEHOLDER", lambda v: v)
    return rule_rows(df, [key], rules, list_issues(gaps, "TRANSLATION_IMAGE", lambda v: v), leftovers)
