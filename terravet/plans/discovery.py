"""Source discovery on stored pages: candidates, dedupe, rank, summaries, registry drafts."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import text as X
from ..functions import web as W
from ..session import cut_lineage
from ..scale import blocked_row_number, first_in_group, top_k


def all_items(seeds: DataFrame, searches: DataFrame, seed_links: DataFrame) -> DataFrame:
    """Union of the three ways a URL is found, with a method tag and an input order."""
    def tag(df, rank, method):
        have = lambda c: F.col(c) if c in df.columns else F.lit("")
        return df.select("url", F.lit(method).alias("method"), have("query").alias("query"),
                         have("source_seed").alias("source_seed"), F.lit(rank).alias("method_rank"), "seq")
    return (tag(seeds.filter(W.supported_url(F.col("url"))), 0, "seed")
            .unionByName(tag(searches, 1, "search")).unionByName(tag(seed_links, 2, "seed_link")))


def first_per_url(items: DataFrame, order: Sequence[str] = ("method_rank", "seq")) -> DataFrame:
    keyed = items.withColumn("canonical", W.canonicalize_url(F.col("url")))
    return first_in_group(keyed, ["canonical"], [F.col(c) for c in order])


def best_per_url(candidates: DataFrame) -> DataFrame:
    """Highest score per canonical URL; the earliest wins a tie."""
    return first_in_group(candidates, ["canonical"], [F.desc("score"), F.col("seq")])


def candidate_order() -> list[Column]:
    return [F.desc("score"), F.col("authority"), F.col("title"), F.col("canonical")]


def rank_candidates(candidates: DataFrame, min_score: int = 0, limit: int | None = None) -> DataFrame:
    out = candidates.filter(F.col("score") >= min_score).orderBy(*candidate_order())
    return out.limit(limit) if limit else out


def rank_links(links: DataFrame, k: int) -> DataFrame:
    """Best k positive links of each seed page; equal scores keep page order."""
    return top_k(links.filter("relevance > 0"), ["seed_url"], [F.desc("relevance"), F.col("pos")], k, "rank")


def seed_page_links(pages: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """Links of stored pages with their relevance, one row per distinct link of a page."""
    links = pages.select(F.col("url").alias("seed_url"), F.posexplode(
        W.extract_links(F.col("html"), F.col("url"))).alias("pos", "link"))
    return links.select("seed_url", "pos", "link.url", "link.anchor",
                        W.link_relevance(F.col("link.url"), F.col("link.anchor"), terms).alias("relevance"))


def candidates(pages: DataFrame, year: int, terms: list[str] | None = None) -> DataFrame:
    """Candidate row per stored page: metadata, date, class and score, in one narrow stage."""
    meta = pages.select("seq", "url", "content_type", "html", F.inline(F.array(W.page_metadata(F.col("html")))))
    text = F.concat_ws(" ", "description", "text", "html")
    staged = meta.select(
        "seq", "url", "content_type",
        F.when(F.col("title") != "", F.col("title")).otherwise(W.title_from_url(F.col("url"))).alias("title"),
        text.alias("text"), W.published_date(F.col("meta"), F.col("title"), F.col("description"), F.col("url"),
                                             F.col("html")).alias("published_date"))
    scored = staged.select("*", F.inline(F.array(W.score_candidate(
        F.col("url"), F.col("title"), F.col("text"), F.col("published_date"), F.col("content_type"), year, terms))))
    return scored.select("seq", "url", W.canonicalize_url(F.col("url")).alias("canonical"), "title", "published_date",
                         "content_type", "score", "authority", "recency", "topic_hits", "notes",
                         W.review_bucket(F.col("score")).alias("review_bucket"))


def discover(pages: DataFrame, year: int, min_score: int = 0, limit: int | None = None,
             terms: list[str] | None = None, include_excluded: bool = False) -> DataFrame:
    found = candidates(pages, year, terms)
    if not include_excluded:
        found = found.filter("authority <> 'X'")
    return rank_candidates(best_per_url(found), min_score, limit)


def discovery_counts(c: DataFrame) -> DataFrame:
    """Counts by bucket, authority and recency from one pass."""
    sets = c.groupingSets([["review_bucket"], ["authority"], ["recency"]], "review_bucket", "authority", "recency").agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "bucket").when(F.col("g") == 5, "authority").otherwise("recency")
    return sets.select(kind.alias("kind"), F.coalesce("review_bucket", "authority", "recency").alias("value"), "n")


def top_urls_digest(c: DataFrame, k: int = 50) -> DataFrame:
    """sha256 of the first k canonical URLs in rank order (k rows at most are gathered)."""
    head = c.orderBy(*candidate_order()).limit(k)
    ranked = head.agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("score")).alias("s"), "authority", "title", "canonical"))).alias("r"))
    return ranked.select(F.sha2(F.array_join(F.transform("r", lambda x: x["canonical"]), "\n"), 256).alias("top_urls_sha256"))


def discovery_summary(c: DataFrame) -> DataFrame:
    digest = top_urls_digest(c).select(F.lit("top_urls_sha256").alias("kind"), F.col("top_urls_sha256").alias("value"),
                                       F.lit(1).cast("bigint").alias("n"))
    return discovery_counts(c).unionByName(digest)


# ---- registry drafts -------------------------------------------------------------

def new_urls(rows: DataFrame, registry: DataFrame) -> DataFrame:
    known = registry.select(W.canonicalize_url_keep_query(F.col("url")).alias("canonical")).distinct()
    return rows.filter(X.blank(F.col("url")) != "").withColumn(
        "canonical", W.canonicalize_url_keep_query(F.col("url"))).join(known, "canonical", "left_anti")


def suffix_ids(rows: DataFrame, id_col: str = "source_id", order: str = "seq", block: int = 1_000_000) -> DataFrame:
    """id, id-2, id-3 ... in order: the first form that no earlier row has.

    A generated ``X-2`` can only meet a row whose own id is ``X-2``, so ids without such
    a relation are numbered by blocks.  Families in which ids meet are read in order; a
    reader holds the distinct ids of its family and a counter for each.
    """
    ids = rows.select(F.col(id_col).alias("id")).distinct()
    stem = F.regexp_extract("id", r"^(.*)-[1-9][0-9]*$", 1)
    ties = ids.withColumn("stem", stem).filter("stem <> ''").join(ids.select(F.col("id").alias("stem")), "stem")
    if not ties.limit(1).count():
        return _numbered(rows, id_col, order, block)
    roots = cut_lineage(ties.select("id", F.col("stem").alias("root")))
    while True:
        up = roots.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = cut_lineage(roots.join(up, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = moved.drop("moved")
        if not moved.filter("moved").limit(1).count():
            break
    members = roots.unionByName(roots.select(F.col("root").alias("id"), "root")).distinct()
    key = members.select(F.col("id").alias(id_col), F.col("root").alias("__root"))
    apart = _numbered(rows.join(key.select(id_col), id_col, "left_anti"), id_col, order, block)
    met = rows.join(key, id_col).withColumn("__kind", F.lit(1)).unionByName(
        key.withColumn("__kind", F.lit(0)), allowMissingColumns=True)
    held = met.repartition("__root").sortWithinPartitions("__root", "__kind", order).select("__root", "__kind", *rows.columns)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return apart.unionByName(held.mapInArrow(_first_free(id_col), fields))


def _numbered(rows: DataFrame, id_col: str, order: str, block: int) -> DataFrame:
    numbered = blocked_row_number(rows, [id_col], [order], F.floor(F.col(order) / block), "__n")
    new = F.when(F.col("__n") == 1, F.col(id_col)).otherwise(F.concat(F.col(id_col), F.lit("-"), F.col("__n")))
    return numbered.withColumn(id_col, new).select(*rows.columns)


def _first_free(id_col: str):
    """Reader of families: their distinct ids come first (kind 0), then the rows in order."""
    def run(batches):
        root, known, used, following = None, set(), set(), {}
        for batch in batches:
            new, keep = [], []
            for r, kind, own in zip(*[batch.column(c).to_pylist() for c in ("__root", "__kind", id_col)]):
                if r != root:
                    root, known, used, following = r, set(), set(), {}
                keep.append(kind == 1)
                if kind == 0:
                    known.add(own)
                    new.append(own)
                    continue
                made, n = own, following.get(own, 2)
                while made in used:
                    made, n = f"{own}-{n}", n + 1
                following[own] = n
                if made in known:
                    used.add(made)
                new.append(made)
            at = batch.schema.names.index(id_col)
            columns = [pa.array(new, batch.schema.types[at]) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns[2:], names=batch.schema.names[2:]).filter(pa.array(keep))
    return run


def registry_draft(rows: DataFrame, registry: DataFrame, year: int, accessed: str) -> DataFrame:
    """Draft registry rows for the URLs the registry does not hold yet."""
    topic = F.when(X.blank(F.col("topic")) != "", F.col("topic")).otherwise(
        X.blank(F.col("topic_hits")))
    title = F.coalesce(F.nullif("title", F.lit("")), F.col("url"))
    fresh = new_urls(rows, registry).withColumn("title", title)
    dated = F.coalesce(F.nullif("published_date", F.lit("")), W.parse_dateish(F.concat_ws(" ", "title", "url", X.blank(F.col("notes")))))
    authority = F.coalesce(F.nullif("authority", F.lit("")), W.classify_authority(F.col("url"), F.col("title"), F.col("notes")))
    staged = fresh.withColumn("published_date", F.when(dated.rlike(P.DATE_PATTERN), dated)).withColumn(
        "authority", authority).withColumn("access", W.registry_access(F.col("type"), F.col("notes"), F.col("url"))).withColumn(
        "recency", F.coalesce(F.nullif("recency", F.lit("")), W.classify_recency(
            F.col("published_date"), F.col("title"), F.col("notes"), year)))
    seed = F.coalesce(F.nullif("id", F.lit("")), F.concat(F.col("title"), F.lit("-"), F.left(F.sha1("url"), F.lit(8))))
    topics = F.coalesce(F.nullif("topic", F.lit("")), F.nullif("topic_hits", F.lit("")), F.lit("public_source_candidate"))
    draft = staged.select(
        "seq", "canonical", W.normalize_id(seed, F.col("url")).alias("source_id"), "title",
        F.lit(P.DRAFT_PUBLISHER).alias("publisher"),
        W.registry_source_kind(F.col("authority"), F.col("url"), F.col("title"), F.col("topic"), F.col("notes")).alias("source_kind"),
        "url", "published_date", F.coalesce(F.nullif("accessed_date", F.lit("")), F.lit(accessed)).alias("accessed_date"),
        W.registry_file_type(F.col("type"), F.col("content_type"), F.col("url")).alias("file_type"),
        F.when(F.col("authority").isin("A0", "A1", "A2", "A3"), F.col("authority")).otherwise("A2").alias("authority_level"),
        F.when(F.col("recency").isin(*P.RECENCY_POINTS), F.col("recency")).otherwise("NA").alias("timeliness_level"),
        F.col("access").alias("public_access_status"), F.lit(P.DRAFT_LICENSE).alias("license_summary"),
        F.lit("needs_review").alias("review_status"),
        W.registry_formal_use(F.col("authority"), F.col("access")).alias("usable_for_formal"),
        W.registry_allowed_uses(topic, F.col("authority")).alias("allowed_uses"),
        W.registry_prohibited_uses(F.col("title"), F.col("notes"), F.col("access")).alias("prohibited_uses"),
        F.filter(F.split(topics, f"(?:[|,，;；]|{X.WS})+"), lambda v: v != "").alias("topics"))
    return suffix_ids(first_in_group(draft, ["canonical"], [F.col("seq")])).drop("canonical")


# ---- registry validation and summary -----------------------------------------------

def registry_role() -> Column:
    formal, status = F.col("usable_for_formal"), F.col("review_status")
    return (F.when((status == "approved") & (formal == "yes"), "approved_formal")
            .when(formal == "provisional_only", "provisional").when(formal == "background_only", "background")
            .when(status == "needs_review", "needs_review"))


def registry_counts(reg: DataFrame) -> DataFrame:
    cols = ["review_status", "usable_for_formal", "authority_level"]
    filled = reg.select(*[F.coalesce(F.col(c), F.lit("unknown")).alias(c) for c in cols])
    sets = filled.groupingSets([[], *[[c] for c in cols]], *cols).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    kind = (F.when(F.col("g") == 7, "total").when(F.col("g") == 3, cols[0]).when(F.col("g") == 5, cols[1]).otherwise(cols[2]))
    return sets.select(kind.alias("kind"), F.coalesce(*cols, F.lit("")).alias("value"), "n")


def registry_roles(reg: DataFrame, k: int = 8, order: str = "pos") -> DataFrame:
    """First k sources of each role, in registry order."""
    return top_k(reg.withColumn("role", registry_role()).filter("role IS NOT NULL"), ["role"], [F.col(order)], k, "rank")
