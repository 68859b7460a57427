"""Parcel-indicator extraction from stored texts, with the stated-total gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import indicators as I
from ..functions.text import blank
from ..operators.aggregates import reconcile
from ..operators.checks import plausible
from ..operators.sequences import dedupe_codes, numbers
from ..scale import first_in_group


def plot_rows(texts: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """Plot rows of each text: token tables by bands, other texts by lines."""
    table = I.tokens_of(I.repaired(F.col(text)))
    found = F.when(table.isNotNull(), I.plot_rows_tokens(F.col(text))).otherwise(I.plot_rows_plain(F.col(text)))
    coded = texts.select(doc, F.inline(found)).filter("vals IS NOT NULL")
    first = first_in_group(coded, [doc, "code"], [F.col("line")]).select(doc, F.col("line").cast("int").alias("seq"), "code", F.lit("").alias("lu"), "vals.*")
    lettered = texts.select(doc, F.posexplode(I.six_column_rows(F.col(text))).alias("pos", "r")).select(
        doc, (F.col("pos") + 1_000_000).alias("seq"), "r.code", "r.lu", "r.vals.*")
    return dedupe_codes(first.unionByName(lettered), [doc])


def stated_totals(texts: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """Stated land and floor totals, where a total row gives both."""
    items = I.tokens_of(F.col(text))

    def near(ts):
        anchor = F.get(F.filter(ts, lambda t: t["text"].rlike("总|合") & F.contains(t["text"], F.lit("计"))), F.lit(0))
        line = F.array_sort(F.transform(F.filter(ts, lambda t: F.abs(t["y"] - anchor["y"]) <= 40), lambda t: F.struct(t["x"], t["text"])))
        return F.filter(numbers(I.joined_decimals(F.array_join(F.transform(line, lambda t: t["text"]), " "))), lambda v: v >= 100)
    n = F.when(items.isNotNull(), I.let(items, near)).otherwise(I.total_numbers(F.col(text)))
    return texts.select(doc, n.alias("n")).filter(F.size("n") >= 2).select(doc, F.col("n")[0].alias("total_land"), F.col("n")[1].alias("total_floor"))


def extract(texts: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """Plausible plot rows of the texts whose sums agree with the stated totals."""
    rows = plot_rows(texts, doc, text).filter(plausible(F.col("land"), F.col("floor")))
    typed = rows.withColumnsRenamed({"land": "land_text", "floor": "floor_text"}).withColumn(
        "land", F.col("land_text").cast("double")).withColumn("floor", F.col("floor_text").cast("double"))
    return reconcile(typed, stated_totals(texts, doc, text), doc)


def notice_rows(texts: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """Notice-level row: numbers, dates and label reads of the whole text."""
    t = F.col(text)
    return texts.select(doc, I.doc_no(t).alias("doc_no"), I.notice_no(t).alias("notice_no"), I.notice_date(t).alias("notice_date"),
                        I.announcement_reads(t).alias("a"), I.label_reads(t).alias("l")).select(
        doc, "doc_no", "notice_no", "notice_date", blank(F.coalesce("a.land", "l.land")).alias("land_area_sqm"),
        blank(F.coalesce("a.floor", "l.floor")).alias("floor_area_sqm"), "l.far", "l.h", "l.density", "l.green")
