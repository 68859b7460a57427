"""Join operators: coverage, citation integrity, mentions, hashes, comparisons."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import text as X
from ..scale import dealt
from ..session import cut_lineage
from .checks import with_each
from .rows import for_all

#: Tokens of an automaton, and characters of a token on average: they bound what a task holds of a dictionary.
SHARD_TOKENS, SHARD_CHARS = 100_000, 64


def missing(required: DataFrame, scopes: DataFrame, covered: DataFrame, scope: str, key: str) -> DataFrame:
    """Required keys that a scope does not cover."""
    return with_each(scopes.select(scope).distinct(), required.select(key).distinct()).join(
        covered.select(scope, key).distinct(), [scope, key], "left_anti")


def set_missing(required: Column, covered: Column) -> Column:
    return F.array_sort(F.array_except(required, covered))


def check_citations(refs: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids (submission, kind, id) the text does not cite; data paths match as ``path#...`` too."""
    path = F.when(F.col("kind") == "data", F.substring_index("value", "#", 1)).otherwise(F.col("value"))
    cited = refs.select("submission", "kind", path.alias("id")).distinct()
    return ids.select("submission", "kind", "id").distinct().join(cited, ["submission", "kind", "id"], "left_anti")


def mentions(docs: DataFrame, key: str, text: str, tokens: DataFrame, token: str = "token",
             small: int = 2_000, shard: int = SHARD_TOKENS) -> DataFrame:
    """Distinct (key, token) where the token occurs in the text.

    A token table of at most ``small`` rows becomes one literal array, tested inside the
    row.  A larger one is cut into shards of bounded size by hash; each shard is one
    automaton in every task, and the texts are read once for each shard.  A text gives one
    row for each token that it holds; nothing else is unfolded and no text is shuffled.
    """
    words = tokens.select(F.col(token).alias("token")).filter(X.blank(F.col("token")) != "").distinct()
    head = [r[0] for r in words.limit(small + 1).collect()]
    if len(head) <= small:
        return docs.select(key, F.explode(X.hits(F.col(text), sorted(head))).alias("token"))
    count, chars = words.agg(F.count("*"), F.sum(F.length("token"))).first()
    shards = max(-(-count // shard), -(-chars // (shard * SHARD_CHARS)))
    body = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    schema = f"__key {docs.schema[key].dataType.simpleString()}, token string"
    out = None
    for k in range(shards):
        held = sorted(r[0] for r in words.filter(F.pmod(F.xxhash64("token"), F.lit(shards)) == k).collect())
        part = body.mapInArrow(_finder(held), schema)
        out = part if out is None else out.unionByName(part)
    # A document of several rows is one document.
    return out.withColumnRenamed("__key", key).distinct()


def _finder(tokens: list[str]):
    """Function of Arrow batches (key, text): (key, token) of the tokens of one shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick
        automaton = ahocorasick.Automaton()
        for token in tokens:
            automaton.add_word(token, token)
        automaton.make_automaton()
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column(1)):
                body = text.as_py()
                if body and len(automaton):
                    hits = {token for _, token in automaton.iter(body)}
                    rows += [i] * len(hits)
                    found += hits
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], names=["__key", "token"])
    return run


def match_sources(docs: DataFrame, key: str, text: str, sources: DataFrame) -> DataFrame:
    """Sources mentioned by id, citation, path or url, with the citation shown."""
    label = F.coalesce(*[F.nullif(c, F.lit("")) for c in ("citation", "path", "url")], F.lit(""))
    tokens = sources.select("id", label.alias("label"), F.explode(F.array_distinct(F.array(
        *[F.trim(X.blank(F.col(c))) for c in ("id", "citation", "path", "url")]))).alias("token")).filter("token <> ''")
    hits = mentions(docs, key, text, tokens)
    return hits.join(tokens, "token").select(key, "id", "label").distinct()


def unmatched_lines(docs: DataFrame, key: str, section: str, sources: DataFrame, matched: DataFrame) -> DataFrame:
    """Reference lines that hold no token of a matched source."""
    tokens = sources.select("id", F.explode(F.array_distinct(F.array(
        *[F.trim(X.blank(F.col(c))) for c in ("id", "citation", "path", "url")]))).alias("token")).filter("token <> ''")
    allowed = matched.select(key, "id").join(tokens, "id").groupBy(key).agg(F.collect_set("token").alias("__t"))
    lines = docs.select(key, F.explode(X.reference_lines(F.col(section))).alias("line")).join(allowed, key, "left")
    plain = F.replace(F.col("line"), F.lit("`"), F.lit(""))
    seen = F.exists(F.coalesce("__t", F.array().cast("array<string>")), lambda w: F.contains(plain, w))
    return lines.filter(~seen).select(key, "line")


def join_collections(items: DataFrame, cards: DataFrame) -> DataFrame:
    """Collection items with the card they point to, and whether it is loaded."""
    c = cards.select(F.col("source_path").alias("proposal"), F.col("title").alias("__t"), F.col("author").alias("__a"),
                     F.col("detail_url").alias("__u"), F.lit(True).alias("__l"))
    return items.join(c, "proposal", "left").select(
        *items.columns, F.coalesce(F.nullif("__t", F.lit("")), F.col("proposal")).alias("title"),
        F.coalesce(F.nullif("__a", F.lit("")), F.lit("未载入")).alias("author"), F.coalesce("__u", F.lit("")).alias("url"),
        F.coalesce("__l", F.lit(False)).alias("loaded"))


def label_tags(df: DataFrame, key: str, tags: str, dim: DataFrame, k: int) -> DataFrame:
    """First k ids of a list with their titles; an unknown id is its own title."""
    one = df.select(key, F.posexplode(F.slice(tags, 1, k)).alias("pos", "id"))
    return one.join(dim.select("id", F.col("title").alias("__t")), "id", "left").select(
        key, "pos", "id", F.coalesce(F.nullif("__t", F.lit("")), F.col("id")).alias("title"))


def check_hashes(listed: DataFrame, files: DataFrame) -> DataFrame:
    both = listed.join(files.select("submission", "path", F.col("sha256").alias("__s")), ["submission", "path"], "left")
    verdict = (F.when(F.col("__s").isNull(), "missing_file").when(X.blank(F.col("sha256")) == "", "missing_hash")
               .when(F.col("sha256") != F.col("__s"), "mismatch").otherwise("match"))
    return both.select("submission", "path", verdict.alias("verdict"))


def changed_files(listed: DataFrame, files: DataFrame) -> DataFrame:
    both = listed.filter(X.blank(F.col("sha256")) != "").join(
        files.select("submission", "path", F.col("sha256").alias("__s")), ["submission", "path"])
    return both.filter(F.col("__s") != F.col("sha256")).select("submission", "path")


def compare_metrics(declared: DataFrame, computed: DataFrame) -> DataFrame:
    """Declared against recomputed values: within max(1 sqm or 0.01, 1 percent)."""
    both = declared.filter("value IS NOT NULL").join(
        computed.select("submission", "metric", F.col("value").alias("expected")), ["submission", "metric"])
    slack = F.greatest(F.when(F.col("unit") == "sqm", 1.0).otherwise(0.01), F.abs("expected") * 0.01)
    reason = (F.when((F.col("unit") == "ratio") & ~F.col("value").between(0, 1), "METRIC_RATIO_RANGE")
              .when(F.abs(F.col("value") - F.col("expected")) > slack, "METRIC_RECALC_MISMATCH"))
    return both.select("submission", "metric", "value", "expected", reason.alias("check_id")).filter("check_id IS NOT NULL")


HTML_METRIC = r"(?i)data-metric\s*=\s*['\"]([^'\"]+)['\"][^>]*data-value\s*=\s*['\"]([^'\"]+)['\"]"


def html_metrics(html: Column) -> Column:
    """Numeric (name, value) pairs of the metric attributes; the last of a name counts."""
    h = X.blank(html)
    pairs = F.transform(F.arrays_zip(F.regexp_extract_all(h, F.lit(HTML_METRIC), F.lit(1)).alias("n"),
                                     F.regexp_extract_all(h, F.lit(HTML_METRIC), F.lit(2)).alias("v")),
                        lambda p: F.struct(X.unescape(p["n"]).alias("name"), F.trim(p["v"]).try_cast("double").alias("value")))
    return F.filter(pairs, lambda p: p["value"].isNotNull())


def compare_html_metrics(pages: DataFrame, metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """Required page metrics: missing, without a known source, or off by more than 1e-6."""
    def last(n):
        return F.try_element_at(F.filter(F.col("__m"), lambda p: p["name"] == n), F.lit(-1))["value"]
    shown = pages.withColumn("__m", html_metrics(F.col("html"))).select("submission", F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), last(n).alias("shown")) for n in names])).alias("s")).select("submission", "s.*")
    known = metrics.select("submission", "metric", "status", F.col("value").alias("expected"))
    both = shown.join(known, ["submission", "metric"], "left")
    slack = F.greatest(F.abs("expected") * 1e-6, F.lit(1e-6))
    verdict = (F.when(F.col("shown").isNull(), "VISUAL_METRIC_MISSING")
               .when(~F.coalesce(F.col("status") == "known", F.lit(False)) | F.col("expected").isNull(), "VISUAL_METRIC_SOURCE_MISSING")
               .when(F.abs(F.col("shown") - F.col("expected")) > slack, "VISUAL_METRIC_MISMATCH"))
    return both.select("submission", "metric", verdict.alias("check_id")).filter("check_id IS NOT NULL")


def apply_overrides(rules: DataFrame, overrides: DataFrame, key: str = "constraint_id") -> DataFrame:
    """Override columns win where they are set."""
    cols = [c for c in overrides.columns if c != key and c in rules.columns]
    ov = overrides.select(key, *[F.col(c).alias(f"__{c}") for c in cols])
    return rules.join(ov, key, "left").select(*[
        F.coalesce(f"__{c}", c).alias(c) if c in cols else F.col(c) for c in rules.columns])


def dangling_ids(matrix: DataFrame, keys: Sequence[str], ids: str, known: DataFrame) -> DataFrame:
    """Referenced ids that do not exist in the submission."""
    return matrix.select("submission", *keys, F.explode(ids).alias("id")).join(
        known.select("submission", "id").distinct(), ["submission", "id"], "left_anti")


def missing_areas(features: DataFrame, ids: Sequence[str], group: str = "submission", col: str = "area_id",
                  submissions: DataFrame | None = None) -> DataFrame:
    flags = [F.coalesce(F.bool_or(F.col(col) == i), F.lit(False)).alias(f"a{n}") for n, i in enumerate(sorted(ids))]
    gaps = F.array_compact(F.array(*[F.when(~F.col(f"a{n}"), F.lit(i)) for n, i in enumerate(sorted(ids))]))
    return for_all(features.groupBy(group).agg(*flags), submissions, group).select(group, F.array_join(gaps, ", ").alias("missing")).filter("missing <> ''")


def undeclared_metrics(submissions: DataFrame, metrics: DataFrame, required: DataFrame) -> DataFrame:
    return missing(required, submissions, metrics, "submission", "metric")


def touched(changes: DataFrame, path: str = "path") -> DataFrame:
    """Proposal of each changed file under ``submissions``."""
    p = F.split(path, "/")
    return changes.filter((F.size(p) >= 3) & (p[0] == "submissions")).select(
        F.concat(F.array_join(F.slice(p, 1, 3), "/"), F.lit("/proposal.md")).alias("proposal")).distinct()


def gallery(packages: DataFrame, publication: DataFrame) -> DataFrame:
    """Published packages with their class; anything but ready is flagged."""
    live = publication.filter(F.col("published").eqNullSafe(F.lit(True))).drop("published")
    return packages.join(live, "path").withColumn("publishable", F.col("status_key") == "formal_review_ready")


#: Cells of ``snap`` are halved until a candidate has at most so many others in its cell, this many times at most.
CROWD, HALVINGS = 32, 8


def _foot(x: Column, y: Column) -> tuple[Column, Column]:
    """Nearest point of the segment (x1, y1, x2, y2) of the row."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.when(dx * dx + dy * dy == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (
        (x - F.col("x1")) * dx + (y - F.col("y1")) * dy) / (dx * dx + dy * dy))))
    return F.col("x1") + t * dx, F.col("y1") + t * dy


def _distance(x: Column, y: Column) -> Column:
    px, py = _foot(x, y)
    return F.sqrt((x - px) ** 2 + (y - py) ** 2)


def snap(vertices: DataFrame, segments: DataFrame, radius_m: float = 200.0) -> DataFrame:
    """Nearest point on a segment within the radius; unmatched vertices are kept.

    Segments are filed in all grid cells their widened box touches.  A cell keeps those
    that can be nearest to one of its points: a segment that is farther from the middle
    than another by more than the diagonal cannot.  Crowded cells are halved and judged
    again, so the candidates of a place do not grow with the segments around it.  A vertex
    looks only into its own cell, and vertices at one place are measured once.
    """
    def reach(lat):
        return F.greatest(G.deg_per_m(lat)["x"], G.deg_per_m(lat)["y"]) * radius_m
    # Largest reach in degrees at the latitudes present: one number.
    far = vertices.agg(F.max(F.abs("lat"))).first()[0]
    if far is None:
        return vertices.withColumn("snap_lon", F.lit(None).cast("double")).withColumn("snap_lat", F.lit(None).cast("double"))
    cell = vertices.sparkSession.range(1).select(reach(F.lit(float(far)))).first()[0]
    spots = cut_lineage(vertices.select("lon", "lat").filter("lon IS NOT NULL AND lat IS NOT NULL").distinct())

    def placed(side):
        return spots.select("lon", "lat", F.floor(F.col("lon") / side).cast("bigint").alias("cx"), F.floor(F.col("lat") / side).cast("bigint").alias("cy"))

    def judged(filed, side):
        """Candidates in cells with a vertex, near enough to one of its points."""
        held = filed.join(placed(side).select("cx", "cy").distinct(), ["cx", "cy"], "left_semi")
        middle = _distance((F.col("cx") + 0.5) * side, (F.col("cy") + 0.5) * side)
        diagonal = side * 2 ** 0.5
        # 1e-9 degrees, a tenth of a millimetre, stand above any rounding of the distances.
        kept = held.withColumn("__d", middle).withColumn("__m", F.min("__d").over(Window.partitionBy("cx", "cy"))).filter(
            (F.col("__d") <= F.col("__m") + diagonal + 1e-9) & (F.col("__d") <= cell + diagonal / 2 + 1e-9))
        return cut_lineage(kept.drop("__d", "__m"))

    low = lambda a, b: F.floor((F.least(a, b) - cell) / cell).cast("bigint")
    high = lambda a, b: F.floor((F.greatest(a, b) + cell) / cell).cast("bigint")
    # Of equal segments the smallest id counts.
    lines = segments.groupBy("x1", "y1", "x2", "y2").agg(F.min(F.struct("segment_id")).alias("__s")).select(
        "__s.segment_id", "x1", "y1", "x2", "y2")
    side, found = cell, judged(lines.withColumn("cx", F.explode(F.sequence(low("x1", "x2"), high("x1", "x2")))).withColumn(
        "cy", F.explode(F.sequence(low("y1", "y2"), high("y1", "y2")))), cell)
    for _ in range(HALVINGS):
        crowd = found.groupBy("cx", "cy").count().agg(F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()[0]
        if (crowd or 0) <= CROWD:
            break
        side, half = side / 2, lambda c: F.explode(F.sequence(F.col(c) * 2, F.col(c) * 2 + 1))
        found = judged(found.withColumn("cx", half("cx")).withColumn("cy", half("cy")), side)
    px, py = _foot(F.col("lon"), F.col("lat"))
    near = placed(side).join(dealt(found), ["cx", "cy"]).select("lon", "lat", "segment_id", px.alias("px"), py.alias("py")).withColumn(
        "d", F.sqrt((F.col("lon") - F.col("px")) ** 2 + (F.col("lat") - F.col("py")) ** 2))
    nearest = near.filter(F.col("d") < reach(F.col("lat"))).groupBy("lon", "lat").agg(
        F.min(F.struct("d", "segment_id", "px", "py")).alias("__n"))
    best = vertices.select("vertex_id", "lon", "lat").join(nearest, ["lon", "lat"]).groupBy("vertex_id").agg(F.min("__n").alias("b"))
    return vertices.join(best, "vertex_id", "left").select(
        *vertices.columns, F.col("b.px").alias("snap_lon"), F.col("b.py").alias("snap_lat"))


def match_rings(parts: DataFrame, zones: DataFrame, eps: float = 1e-9) -> DataFrame:
    """Parts of a multipolygon that equal a zone's ring point by point.

    Rings meet on their size and on the rounded first point (and the rounding
    neighbours), then every coordinate is compared.
    """
    def first(r, axis):
        return F.floor(r[0][axis] / (eps * 1000)).cast("bigint")
    z = zones.select("zone_id", F.col("ring").alias("__z"), F.size("ring").alias("__n"),
                     F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("ox")).withColumn("oy", F.explode(F.sequence(F.lit(-1), F.lit(1))))
    z = z.select("zone_id", "__z", "__n", (first(F.col("__z"), "x") + F.col("ox")).alias("__x"), (first(F.col("__z"), "y") + F.col("oy")).alias("__y"))
    p = parts.withColumn("__n", F.size("ring")).withColumn("__x", first(F.col("ring"), "x")).withColumn("__y", first(F.col("ring"), "y"))
    same = F.forall(F.zip_with("ring", "__z", lambda a, b: (F.abs(a["x"] - b["x"]) <= eps) & (F.abs(a["y"] - b["y"]) <= eps)), lambda v: v)
    return p.join(dealt(z), ["__n", "__x", "__y"]).filter(same).drop("__n", "__x", "__y", "__z")


def norm_paths(changes: DataFrame, path: str = "path") -> DataFrame:
    """Normalised, distinct, sorted change list."""
    clean = F.regexp_replace(F.replace(X.strip(X.blank(F.col(path))), F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    return changes.select(F.regexp_replace(clean, "/{2,}", "/").alias("path")).filter("path <> ''").distinct().orderBy("path")
