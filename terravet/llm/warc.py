"""WARC archives of pages and a globally ordered index of their captures.

Writing.  Every page becomes one record; of the records with equal payloads of at least
LEAST_REVISIT bytes the one with the largest page_id keeps the payload, the others are
revisits that refer to it.  Records are text rows (header, HTTP header, payload) that
Spark writes with CRLF between them, which gives plain WARC 1.1 files, with Spark's own
commit of finished files.  A file holds about ARCHIVE_BYTES and never more than
MOST_BYTES, unless a single record does.

Reading.  Files are read whole, one at a time, and cut into records by Content-Length, so
a payload may hold anything, also something like a record.  Digests are computed again.

Index.  Each archive gives a run of its captures, sorted by URL key and date; the runs are
written.  They are then dealt to ranges of (URL key, date, record), so that a URL with a
third of all captures is cut by its dates.  In each range the parts of the runs meet in a
k-way merge by a loser tree, and the counts of the ranges give every capture its global
position and its number in the history of its URL.

Defined results: a null html is an empty payload; a null url has no target line and the
empty URL key, a null page_id no page line, and both read back as null; line breaks in a url are
written as %0D and %0A.  Among equal payloads nulls are the smallest page_id, the largest
url decides between equal page_ids, and of rows that are equal in all three one is the
response; rows alike otherwise share a record id.  Smaller payloads are all responses.  Very long pages are kept whole (a record
up to Spark's limit of 2 GB for a value).  Other columns are not written, so clashing names
do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravet.session import ensure_checkpoint_dir

from .common import read, stored

LEAST_REVISIT = 1000
ARCHIVE_BYTES, MOST_BYTES = 32 << 20, 1 << 30
#: Room for the headers of a record beside payload and url.
HEADER_BYTES = 1024
#: Captures of a range of the merged index: at most about, and at least where the session has tasks for more.
RANGE_CAPTURES, FEWEST_CAPTURES = 200_000, 1_000
#: 2024-01-01, in seconds.
FIRST_SECOND = 1_704_067_200
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def capture_date(page_id: Column) -> Column:
    """Date of a capture where the table has none: one second for each page_id, over three years."""
    second = F.pmod(F.coalesce(page_id, F.lit(0)).cast("bigint"), F.lit(94_608_000))
    return F.timestamp_seconds(F.lit(FIRST_SECOND) + second)


def _measured(pages: DataFrame, date: str | None) -> DataFrame:
    """page_id, url, payload, its size and digests, and the date of the capture."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    when = F.col(date) if date else capture_date(F.col("page_id"))
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"),
                        when.alias("date")).select(
        "page_id", "url", "payload", "date", F.octet_length("payload").cast("bigint").alias("size"),
        F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("payload_key"))


def _record_id(page_id: Column, url: Column, key: Column, copy: Column) -> Column:
    h = F.md5(F.concat_ws("\n", F.coalesce(page_id.cast("string"), F.lit("-")), F.coalesce(url, F.lit("-")), key, copy.cast("string")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _records(rows: DataFrame) -> DataFrame:
    """The text of each record; ``top`` is null for a response, else the response it refers to."""
    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))

    def plain(url: Column) -> Column:
        return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))

    revisit = F.col("top").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("size").cast("string"), F.lit(CRLF + CRLF))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("size"))
    return rows.select(F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("url"), F.col("payload_key"), F.col("copy"))),
        line("WARC-Date", F.date_format(F.to_utc_timestamp("date", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Target-URI", plain(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        line("WARC-Refers-To", F.when(revisit, _record_id(F.col("top.page_id"), F.col("top.url"), F.col("payload_key"), F.lit(1)))),
        line("WARC-Refers-To-Target-URI", plain(F.col("top.url"))),
        line("Archive-Page", F.col("page_id").cast("string")), line("Archive-Refers-To-Page", F.col("top.page_id").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", length.cast("string")),
        F.lit(CRLF), http, body, F.lit(CRLF)).alias("value"))


def write_archives(pages: DataFrame, date: str | None = None, path: str | None = None) -> str:
    """Writes the WARC files of ``pages`` (page_id, url, html) and returns their folder."""
    spark = pages.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    rows = _measured(pages, date)
    sizes = stored(rows.drop("payload", "sha1"), "warc-sizes")
    stats = sizes.agg(F.avg("size"), F.max(F.col("size") + F.coalesce(F.octet_length("url"), F.lit(0)))).first()
    mean, most = (stats[0] or 0) + HEADER_BYTES, (stats[1] or 0) + HEADER_BYTES
    per_file = max(1, min(int(ARCHIVE_BYTES // mean), int(MOST_BYTES // most)))
    # One row for each payload that occurs more than once; Spark broadcasts it only where the stored table is small.
    top = F.max(F.struct("page_id", "url"))
    groups = (sizes.filter(F.col("size") >= LEAST_REVISIT).groupBy("payload_key").agg(F.count("*").alias("copies"), top.alias("top"))
              .filter("copies > 1"))
    groups = stored(groups, "warc-groups")
    joined = rows.join(groups, "payload_key", "left")
    first = (F.col("page_id").eqNullSafe(F.col("top.page_id")) & F.col("url").eqNullSafe(F.col("top.url")))
    marked = joined.withColumn("first", F.col("copies").isNull() | first)
    none = F.lit(None).cast(groups.schema["top"].dataType)
    # Rows equal to the response in page_id, url and payload: one of them is the response.
    equal = (sizes.join(groups, "payload_key").filter(first).groupBy("payload_key").count().filter("count > 1"))
    equal = stored(equal, "warc-equal")
    if equal.isEmpty():
        made = marked.withColumn("copy", F.lit(1)).withColumn("top", F.when(F.col("first"), none).otherwise(F.col("top")))
    else:
        doubtful = marked.filter("first").join(equal.select("payload_key"), "payload_key", "left_semi")
        clear = marked.join(equal.select("payload_key", F.lit(True).alias("first")), ["payload_key", "first"], "left_anti")
        one = F.row_number().over(Window.partitionBy("payload_key").orderBy("page_id"))  # rows alike: any of them
        response = doubtful.withColumn("__n", one).filter("__n = 1").drop("__n").withColumn("top", none)
        rest = (doubtful.groupBy("payload_key").agg(*[F.first(c).alias(c) for c in marked.columns if c not in ("payload_key", "payload")])
                .withColumn("payload", F.lit("")).join(equal, "payload_key")
                .withColumn("copy", F.explode(F.sequence(F.lit(2), F.col("count").cast("int")))).drop("count"))
        made = (clear.withColumn("top", F.when(F.col("first"), none).otherwise(F.col("top"))).withColumn("copy", F.lit(1))
                .unionByName(response.withColumn("copy", F.lit(1))).unionByName(rest))
    _records(made).write.option("lineSep", CRLF).option("maxRecordsPerFile", per_file).text(path)
    return path


RECORD = ("page_id bigint, url string, date string, record_type string, record_id string, payload_bytes bigint, "
          "payload_digest string, refers_to bigint, refers_to_id string, intact boolean, url_key string, run bigint, pos bigint")
FIELDS = [part.strip().split(" ")[0] for part in RECORD.split(", ")]


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then path and query; scheme, port 80/443 and fragment left out."""
    if not url:
        return ""
    rest = url.split("#", 1)[0]
    rest = rest.split("://", 1)[1] if "://" in rest else rest
    cut = min([rest.find(c) for c in "/?" if c in rest] or [len(rest)])
    host, tail = rest[:cut].rsplit("@", 1)[-1].lower(), rest[cut:]
    name, _, port = host.partition(":")
    name = ",".join(reversed(name.split(".")))
    return f"{name}{'' if port in ('', '80', '443') else ':' + port}){tail if tail.startswith('/') else '/' + tail}"


def parse(content: bytes) -> Iterator[dict]:
    """The records of a WARC file, cut by their Content-Length."""
    at, view = 0, memoryview(content)
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or not content.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {}
        for row in content[at:end].split(b"\r\n")[1:]:
            name, _, value = row.partition(b":")
            fields[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        start = end + 4
        stop = start + int(fields["content-length"])
        if stop > len(content):
            raise ValueError(f"record at byte {at} is cut off")
        split = content.find(b"\r\n\r\n", start, stop)
        fields["http"] = content[start:split].decode("utf-8", "replace") if split >= 0 else ""
        fields["payload"] = view[split + 4 if split >= 0 else start:stop]
        yield fields
        at = stop + 4


def _capture(fields: dict) -> dict:
    revisit = fields.get("warc-type") == "revisit"
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    size = next((int(row.split(":", 1)[1]) for row in fields["http"].split(CRLF) if row.lower().startswith("content-length:")), 0)
    own = stated if revisit else hashlib.sha1(fields["payload"]).hexdigest()
    number = lambda name: int(fields[name]) if name in fields else None
    url = fields.get("warc-target-uri")
    return {"page_id": number("archive-page"), "url": url, "date": fields.get("warc-date", ""),
            "record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id", ""),
            "payload_bytes": size if revisit else len(fields["payload"]), "payload_digest": own,
            "refers_to": number("archive-refers-to-page"), "refers_to_id": fields.get("warc-refers-to"),
            "intact": own == stated and (revisit or size == len(fields["payload"])), "url_key": url_key(url)}


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives below ``path``, as written runs: sorted inside each archive."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    kinds = [(n, t) for n, t in (part.strip().split(" ") for part in RECORD.split(", "))]
    arrow = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                number = int.from_bytes(hashlib.sha256(name.as_py().encode()).digest()[:8], "big") >> 1
                rows = [_capture(fields) for fields in parse(content.as_py())]
                rows.sort(key=_place)
                for pos, row in enumerate(rows):
                    row["run"], row["pos"] = number, pos
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], arrow[t]) for n, t in kinds], names=FIELDS)

    return stored(files.mapInArrow(run, RECORD), "warc-runs")


def _place(row: dict) -> tuple:
    """Order of captures: URL key, date, record."""
    return row["url_key"].encode(), row["date"], row["record_id"]


class LoserTree:
    """Merges sorted streams of (key, value).

    Inner nodes hold the loser of their match; the winner of the last match is on top, and
    only the matches on the path of its stream are played again, one comparison a level.
    """

    def __init__(self, streams: Iterable[Iterator[tuple]]):
        self.streams = list(streams)
        self.heads = [next(s, None) for s in self.streams]
        k = len(self.streams)
        self.losers = [-1] * max(k, 1)  # losers[0] is the winner
        winner = [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            one, two = winner[2 * node], winner[2 * node + 1]
            winner[node], self.losers[node] = (one, two) if self._before(one, two) else (two, one)
        if k:
            self.losers[0] = winner[1] if k > 1 else 0

    def _before(self, one: int, two: int) -> bool:
        a, b = self.heads[one], self.heads[two]
        if a is None or b is None:
            return b is None
        return (a[0], one) < (b[0], two)

    def __iter__(self) -> Iterator:
        k = len(self.streams)
        if not k:
            return
        top = self.losers[0]
        while self.heads[top] is not None:
            yield self.heads[top][1]
            self.heads[top] = next(self.streams[top], None)
            node = (top + k) // 2
            while node:
                if self._before(self.losers[node], top):
                    self.losers[node], top = top, self.losers[node]
                node //= 2


def merged_index(runs: DataFrame, captures: int = RANGE_CAPTURES) -> DataFrame:
    """All columns of the runs, ``position`` in the whole index and ``capture_no`` in the history of the URL key."""
    count = runs.count()
    wanted = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, -(-count // captures), min(wanted, count // FEWEST_CAPTURES))
    dealt = runs.repartitionByRange(ranges, "url_key", "date", "record_id", "run", "pos")
    schema = f"{RECORD}, part int, place bigint"

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        run, pos = np.asarray(table["run"]), np.asarray(table["pos"])
        by_run = np.lexsort((pos, run))  # the shuffle mixes the runs: each one in its own order again
        cuts = np.flatnonzero(np.append(True, np.diff(run[by_run]) != 0)).tolist() + [len(by_run)]
        keys = list(zip([k.encode() for k in table["url_key"].to_pylist()], table["date"].to_pylist(), table["record_id"].to_pylist()))
        streams = [zip([keys[i] for i in own], own) for own in (by_run[a:b].tolist() for a, b in zip(cuts, cuts[1:]))]
        placed = list(LoserTree(streams))
        out = table.take(pa.array(placed)).combine_chunks()
        n = len(placed)
        out = out.append_column("part", pa.array(np.full(n, part, np.int32))).append_column("place", pa.array(np.arange(n)))
        yield from out.to_batches()

    placed = stored(dealt.mapInArrow(merge, schema), "warc-merged")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = placed.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    # A history starts at the first position of its URL key, in whichever range that is.
    placed = placed.join(offsets, "part").withColumn("position", F.col("offset") + F.col("place"))
    inside = Window.partitionBy("part", "url_key").orderBy("place")
    spans = placed.groupBy("url_key", "part").count()
    carried = spans.select("url_key", "part", F.coalesce(F.sum("count").over(
        Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return (placed.join(carried, ["url_key", "part"])
            .withColumn("capture_no", F.col("__before") + F.row_number().over(inside))
            .drop("__before", "part", "place", "offset"))


def op13_capture_index(spark, sf_dir: str) -> DataFrame:
    folder = write_archives(read(spark, sf_dir, "pages"))
    return merged_index(capture_runs(spark, folder)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "position", "capture_no")


OP13_SQL = r"""
WITH rows AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_key,
    octet_length(encode(coalesce(html, ''))) AS size, split_part(coalesce(url, ''), '#', 1) AS whole FROM pages),
cut AS (
  SELECT *, CASE WHEN contains(whole, '://') THEN substr(whole, strpos(whole, '://') + 3) ELSE whole END AS rest FROM rows),
parts AS (
  SELECT *, lower(regexp_extract(rest, '^[^/?]*')) AS host, regexp_replace(rest, '^[^/?]*', '') AS tail FROM cut),
keyed AS (
  SELECT *, CASE WHEN url = '' THEN '' ELSE
    array_to_string(list_reverse(string_split(regexp_extract(regexp_replace(host, '^.*@', ''), '^[^:]*'), '.')), ',')
    || regexp_replace(regexp_extract(regexp_replace(host, '^.*@', ''), ':.*$'), '^:(80|443)?$', '') || ')'
    || CASE WHEN starts_with(tail, '/') THEN tail ELSE '/' || tail END END AS url_key,
    md5(page_id::VARCHAR || chr(10) || url || chr(10) || payload_key || chr(10) || '1') AS record_id,
    CASE WHEN size >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS top
  FROM parts)
SELECT page_id, size::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to, url_key,
  row_number() OVER (ORDER BY url_key, page_id, record_id) - 1 AS position,
  row_number() OVER (PARTITION BY url_key ORDER BY page_id, record_id) AS capture_no
FROM keyed
"""
