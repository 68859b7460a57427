"""Reads of parcel indicators from notice texts and recognised tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P
from ..operators.sequences import greedy_starts, joined_decimals, numbers
from .text import blank, let

VALUES = "struct<land:string,far:string,density:string,h:string,floor:string,green:string>"


def _g(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(blank(text), pattern, group), F.lit(""))


def plain_number(v: Column) -> Column:
    """Number as text: no exponent, no trailing zeros."""
    return F.when(v == F.floor(v), v.cast("decimal(30,0)").cast("string")).otherwise(
        F.regexp_replace(v.cast("decimal(30,8)").cast("string"), r"\.?0+$", ""))


def normalize_plot_code(token: Column) -> Column:
    t = F.translate(blank(token), "Oo", "00")
    head, tail = F.regexp_extract(t, P.PLOT_CODE_PARTS, 1), F.regexp_extract(t, P.PLOT_CODE_PARTS, 2)
    return F.when(head != "", F.concat(F.lit("HD00-"), head, F.lit("-"), tail)).otherwise(token)


def notice_date(text: Column) -> Column:
    p = P.NOTICE_DATE_PATTERN
    return F.when(_g(text, p).isNotNull(), F.concat_ws("-", _g(text, p, 1), F.lpad(_g(text, p, 2), 2, "0"), F.lpad(_g(text, p, 3), 2, "0"))).otherwise("")


def doc_no(text: Column) -> Column:
    new, old = P.DOC_NO_PATTERN, P.DOC_NO_OLD_PATTERN
    return (F.when(_g(text, new).isNotNull(), F.format_string("京规自（海）供审函〔%s〕%s号", _g(text, new, 1), _g(text, new, 2)))
            .when(_g(text, old).isNotNull(), F.format_string("%s规土（海）条供字%s号", _g(text, old, 1), _g(text, old, 2))).otherwise(""))


def notice_no(text: Column) -> Column:
    p = P.NOTICE_NO_PATTERN
    return F.when(_g(text, p).isNotNull(), F.format_string("京土储挂（海）[%s]%s号", _g(text, p, 1), _g(text, p, 2))).otherwise("")


def label_reads(text: Column) -> Column:
    """Struct of the six labelled values, null where absent."""
    return F.struct(*[_g(text, pattern).alias(name) for name, pattern in P.LABEL_PATTERNS.items()])


def announcement_reads(text: Column) -> Column:
    """Land and floor area of a notice: labels first, then the listing table."""
    bare = lambda c: F.replace(c, F.lit(","), F.lit(""))
    land = bare(F.coalesce(*[_g(text, p) for p in P.LAND_AREA_PATTERNS]))
    floor = bare(F.coalesce(*[_g(text, p) for p in P.FLOOR_AREA_PATTERNS]))
    segment = F.regexp_extract(blank(text), r"(?s)挂牌编号(.*)", 1)
    segment = F.substring_index(F.substring_index(segment, "起始价", 1), "万元", 1)
    segment = let(segment, lambda s: F.when(F.instr(s, "（平方米）") > 0, F.substr(s, F.instr(s, "（平方米）"))).otherwise(s))
    nums = F.filter(F.transform(F.regexp_extract_all(segment, F.lit(r"\d[\d,]*\.?\d*"), F.lit(0)),
                                lambda n: bare(n).try_cast("double")), lambda v: v >= 100)

    def fallback(v):
        rest = F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0)))
        return F.struct(F.coalesce(land, F.get(v, F.lit(0)).cast("string")).alias("land"),
                        F.coalesce(floor, plain_number(F.array_max(rest))).alias("floor"))
    return let(nums, fallback)


def six_column_rows(text: Column) -> Column:
    """(code, lu, values) of each lettered plot row in recognised text."""
    t = F.regexp_replace(blank(text), r"(\d+\.)\s*(\d+)", "$1$2")
    rows = F.regexp_extract_all(t, F.lit(P.PLOT_ROW_PATTERN), F.lit(0))
    part = lambda r, g: F.regexp_extract(r, P.PLOT_ROW_PATTERN, g)

    def one(r):
        before = F.substr(r, F.lit(1), F.instr(r, part(r, 2)) - 1)
        return F.struct(F.concat(part(r, 1), F.lit("地块")).alias("code"),
                        F.regexp_extract(before, r"\b([A-Z]\d{1,2})\b", 1).alias("lu"),
                        F.struct(part(r, 2).alias("land"), part(r, 3).alias("far"), part(r, 6).alias("density"),
                                 part(r, 5).alias("h"), part(r, 4).alias("floor"), part(r, 7).alias("green")).alias("vals"))
    return F.transform(rows, one)


def match_values(nums: Column, has_density: Column) -> Column:
    """Ordered, range-bound reading of a row's numbers; null without land and floor.

    Each reading takes the first number in its range after the last one taken; a
    reading that finds none leaves the place where it is.
    """
    def take(v, low, high, allowed=None):
        """Struct (at, value) of the next number in the range."""
        rest = F.sequence(v["at"] + 1, F.greatest(F.size(v["n"]), v["at"] + 1))
        good = F.filter(rest, lambda k: (k <= F.size(v["n"])) & F.get(v["n"], k - 1).between(low, high))
        return F.get(good if allowed is None else F.when(allowed, good), F.lit(0))

    state = F.struct(nums.alias("n"), F.lit(0).alias("at"), *[F.lit(None).cast("double").alias(c) for c in ("land", "far", "density", "h", "floor", "green")])

    def step(s, name, low, high, allowed=None):
        names = ("land", "far", "density", "h", "floor", "green")
        return let(s, lambda v: let(take(v, low, high, allowed), lambda k: F.struct(
            v["n"].alias("n"), F.coalesce(k, v["at"]).alias("at"),
            *[(F.get(v["n"], k - 1) if c == name else v[c]).alias(c) for c in names])))
    s = step(state, "land", 100, 1e300)
    s = step(s, "far", 0.1, 8.0)
    s = step(s, "density", 20, 60, has_density)
    s = step(s, "h", 10, 80)
    s = step(s, "floor", 1000, 1e300)
    s = step(s, "green", 10, 60)
    whole = lambda c: F.floor(c).cast("string")
    # Without a land reading nothing is read; the later readings are then void.
    return let(s, lambda v: F.when(v["land"].isNotNull() & v["floor"].isNotNull(), F.struct(
        plain_number(v["land"]).alias("land"), plain_number(v["far"]).alias("far"), whole(v["density"]).alias("density"),
        whole(v["h"]).alias("h"), whole(v["floor"]).alias("floor"), whole(v["green"]).alias("green"))))


def plot_token(text: Column) -> Column:
    """(token, code) of the first plot code of a line; the fallback form comes second."""
    main = F.regexp_extract(text, P.PLOT_CODE_PATTERN, 0)
    other = F.regexp_extract(text, P.PLOT_CODE_FALLBACK, 0)
    return F.struct(F.when(main != "", main).otherwise(other).alias("token"),
                    F.when(main != "", normalize_plot_code(main)).otherwise(other).alias("code"))


def _window_values(window: Column, token: Column, code: Column, has_density: Column) -> Column:
    """Numbers of a row window, without the plot code and its own digit groups."""
    at = F.instr(window, token)
    rest = F.concat(F.substr(window, F.lit(1), at - 1), F.lit(" "), F.substr(window, at + F.length(token)))
    own = F.transform(F.regexp_extract_all(code, F.lit(r"\d+"), F.lit(0)), lambda s: s)
    nums = F.filter(numbers(F.when(at > 0, rest).otherwise(window)),
                    lambda n: ~F.array_contains(own, F.floor(n).cast("string")))
    return match_values(nums, has_density)


def repaired(text: Column) -> Column:
    """Split decimals joined, a colon read for a decimal point put right."""
    return F.regexp_replace(joined_decimals(blank(text)), r"(\d{3,})[:：](\d{2,3})", "$1.$2")


def plot_rows_plain(text: Column) -> Column:
    """(line, code, values) of each plot-code line and the lines up to the next code."""
    def rows(d):
        lines, marks = d["l"], d["m"]
        idx = F.filter(F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1))), lambda i: F.get(marks, i - 1)["token"] != "")
        return let(idx, lambda ix: F.transform(ix, lambda i: let(F.struct(
            i.alias("i"), F.get(marks, i - 1).alias("m"),
            F.least(F.coalesce(F.array_min(F.filter(ix, lambda j: j > i)), F.size(lines) + 1), F.size(lines) + 1).alias("e")),
            lambda v: F.struct(v["i"].alias("line"), v["m"]["code"].alias("code"), _window_values(
                F.array_join(F.slice(lines, v["i"], v["e"] - v["i"]), " "), v["m"]["token"], v["m"]["code"], d["h"]).alias("vals")))))
    lines = F.split(repaired(text), "\n")
    return let(F.struct(lines.alias("l"), F.transform(lines, plot_token).alias("m"), F.contains(blank(text), F.lit("密度")).alias("h")), rows)


def tokens_of(text: Column) -> Column:
    """(y, x, text) items of a ``y<tab>x<tab>text`` table; null if a line does not fit."""
    lines = F.split(F.regexp_replace(blank(text), "\n$", ""), "\n")
    item = lambda s: F.struct(
        F.regexp_extract(s, r"^(\d+)\t(\d+)\t(.*)$", 1).try_cast("bigint").alias("y"),
        F.regexp_extract(s, r"^(\d+)\t(\d+)\t(.*)$", 2).try_cast("bigint").alias("x"),
        F.regexp_extract(s, r"^(\d+)\t(\d+)\t(.*)$", 3).alias("text"))
    return F.when(F.forall(lines, lambda s: s.rlike(r"^\d+\t\d+\t")), F.transform(lines, item))


def plot_rows_tokens(text: Column, tolerance: int = 25) -> Column:
    """(line, code, values) of each row band of a token table."""
    def band_row(items, start, after, dense, i):
        row = F.array_sort(F.transform(F.filter(items, lambda t: (t["y"] >= start) & F.coalesce(t["y"] < after, F.lit(True))),
                                       lambda t: F.struct(t["x"].alias("x"), t["text"].alias("text"))))
        line = F.array_join(F.transform(row, lambda t: t["text"]), " ")
        main = F.get(F.filter(F.transform(row, lambda t: F.regexp_extract(t["text"], P.PLOT_CODE_PATTERN, 0)), lambda c: c != ""), F.lit(0))
        return let(line, lambda ln: let(F.struct(
            F.coalesce(main, F.regexp_extract(ln, P.PLOT_CODE_FALLBACK, 0)).alias("token"),
            F.coalesce(normalize_plot_code(main), F.regexp_extract(ln, P.PLOT_CODE_FALLBACK, 0)).alias("code")),
            lambda m: F.struct(i.alias("line"), m["code"].alias("code"), F.when(
                m["token"] != "", _window_values(ln, m["token"], m["code"], dense)).alias("vals"))))

    def rows(d):
        starts = greedy_starts(F.array_sort(F.array_distinct(F.transform(d["t"], lambda t: t["y"]))), tolerance)
        return let(starts, lambda s: F.transform(s, lambda y, i: band_row(d["t"], y, F.get(s, i + 1), d["h"], i)))
    return let(F.struct(tokens_of(repaired(text)).alias("t"), F.contains(blank(text), F.lit("密度")).alias("h")), rows)


def total_numbers(text: Column) -> Column:
    """First two numbers of at least 100 on a "total" line of plain text."""
    lines = F.filter(F.split(blank(text), "\n"), lambda s: s.rlike(r"(?:总|合)\s*[计計]"))
    good = F.filter(F.transform(lines, lambda s: F.filter(numbers(s), lambda v: v >= 100)), lambda n: F.size(n) >= 2)
    return F.get(good, F.lit(0))


def only_land_code(text: Column, title: Column, codes=None) -> Column:
    """The one known land code in text or title, else empty."""
    found = F.array_compact(F.array(*[F.when(
        blank(text).rlike(f"(?<![A-Za-z0-9]){c}(?![A-Za-z0-9])") | blank(title).rlike(f"(?<![A-Za-z0-9]){c}(?![A-Za-z0-9])"), F.lit(c))
        for c in (codes or P.LAND_CODES)]))
    return let(found, lambda f: F.when(F.size(f) == 1, F.get(f, F.lit(0))).otherwise(""))


def detail_url(fields: list[Column], host: str, section: str) -> Column:
    """Detail page link from any of the fields; a relative link gets the host."""
    text = F.concat_ws(" ", *[blank(f) for f in fields])
    path = section + r"/[0-9]+/[0-9]+\.html"
    absolute = F.regexp_extract(text, r"https?://" + host.replace(".", r"\.") + "/" + path, 0)
    relative = F.regexp_extract(text, path, 0)
    return F.when(absolute != "", absolute).when(relative != "", F.concat(F.lit(f"https://{host}/"), relative))
