"""Rows of (code, description) out of page text, as windows over its lines.

Markdown tables come first; a page without any table row that has a code is read by a line grammar. All windows are
partitioned by page, so pages are spread over the cluster and nothing larger than a page meets in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import codes, text

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
_OTHER = "(?i)^other:?$"


def _lines(pages: DataFrame, key: str, raw: str) -> DataFrame:
    return pages.select(key, F.posexplode(F.split(F.coalesce(F.col(raw), F.lit("")), LINE_BREAK)).alias("ln", "line")).withColumn("line", text.norm_edges(F.col("line")))


def _first_index(cells: Column, test) -> Column:
    """Index of the first cell that passes, or null."""
    hits = F.filter(F.transform(cells, lambda c, i: F.when(test(c), i)), lambda i: i.isNotNull())
    return F.get(hits, F.lit(0))


def _pick(cells: Column, code_index: Column) -> Column:
    """The longest cell besides the code's: with letters and no rate, else with letters, else any."""
    rest = F.filter(cells, lambda c, i: (i != code_index) & (c != ""))
    lettered = F.filter(rest, lambda c: c.rlike("[A-Za-z]"))
    plain = F.filter(lettered, lambda c: ~text.looks_like_rate(c))
    pool = F.when(F.size(plain) > 0, plain).when(F.size(lettered) > 0, lettered).otherwise(rest)
    best = F.array_max(F.transform(pool, lambda c, i: F.struct(F.length(c).alias("n"), (-i).alias("i"), c.alias("c"))))
    return F.coalesce(best["c"], F.lit(""))


def rows_from_tables(pages: DataFrame, key: str = "page_key", raw: str = "raw") -> DataFrame:
    """(key, pos, code, description): the coded rows of the pages' markdown tables, in order of ``pos``."""
    by_page = Window.partitionBy(key).orderBy("ln")
    lines = _lines(pages, key, raw)
    in_table = F.startswith("line", F.lit("|")) & F.endswith("line", F.lit("|")) & (F.length("line") - F.length(F.replace("line", F.lit("|"))) >= 2)
    lines = lines.withColumn("in_table", in_table).withColumn("table", F.sum((~F.col("in_table")).cast("int")).over(by_page)).where("in_table")
    cells = F.transform(F.split(F.btrim("line", F.lit("|")), r"\|"), text.norm_edges)
    delimiter = F.forall("cells", lambda c: F.replace(c, F.lit(" ")).rlike("^:?-{3,}:?$"))
    by_table = Window.partitionBy(key, "table").orderBy("ln")
    rows = lines.withColumn("cells", cells).where(~delimiter).withColumn("n", F.row_number().over(by_table))

    lower = F.transform("cells", F.lower)
    desc_at = F.when(F.col("n") <= 3, _first_index(lower, lambda c: F.contains(c, F.lit("description"))))
    code_at = _first_index(lower, lambda c: text.any_of(*[F.contains(c, F.lit(k)) for k in ("h.s", "hs", "heading", "code")]))
    suffix_at = _first_index(lower, lambda c: F.contains(c, F.lit("suffix")) | (F.contains(c, F.lit("stat")) & F.contains(c, F.lit("suf"))))
    head = F.min(F.when(desc_at.isNotNull(), F.struct("n", desc_at.alias("desc"), code_at.alias("code"), suffix_at.alias("suffix")))).over(Window.partitionBy(key, "table"))
    rows = rows.withColumn("head", head).where((F.col("head").isNull() | (F.col("n") > F.col("head.n"))) & F.exists("cells", lambda c: c != ""))

    found = F.transform("cells", lambda c, i: F.struct(codes.code_of_cell(c, i == 0).alias("code"), i.alias("i")))
    hinted = F.when(F.col("head.code").isNotNull(), F.struct(codes.code_of_cell(F.get("cells", F.col("head.code")), True).alias("code"), F.col("head.code").alias("i")))
    hinted = F.when(hinted["code"].isNotNull(), hinted)
    rows = rows.withColumn("own", F.coalesce(hinted, F.get(F.filter(found, lambda x: x["code"].isNotNull()), F.lit(0)))).withColumn("own_code", codes.normalize_code(F.col("own.code")))
    rows = rows.withColumn("own_code", F.nullif("own_code", F.lit(""))).withColumn("suffix", F.when(F.col("head.suffix").isNotNull(), codes.suffix_value(F.get("cells", F.col("head.suffix")))))
    # The last code of eight digits, until one of six or fewer comes.
    size = codes.digit_length(F.col("own_code"))
    event = F.when(F.col("own_code").isNull(), None).when(size == 8, F.struct(F.col("own_code").alias("base"))).when(size <= 6, F.struct(F.lit(None).cast("string").alias("base")))
    before = by_table.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("base", F.last(event, ignorenulls=True).over(before)["base"])
    code = F.when(F.col("own_code").isNull(), codes.with_suffix(F.col("base"), F.col("suffix"))).when((size == 8) & F.col("suffix").isNotNull(), F.concat("own_code", "suffix")).otherwise(F.col("own_code"))
    rows = rows.withColumn("code", code)

    cell = F.when(F.col("head.desc").isNotNull(), F.get("cells", F.col("head.desc")))
    said = F.when(F.col("code").isNotNull() & (F.coalesce(cell, F.lit("")) != ""), text.drop_dot_leaders(cell))
    rows = rows.withColumn("said", said)
    picked = F.when(F.col("code").isNotNull() & F.col("said").isNull(), F.nullif(text.drop_dot_leaders(_pick(F.col("cells"), F.coalesce(F.col("own.i"), F.lit(-1)))), F.lit("")))
    rows = rows.withColumn("picked", picked)
    upto = by_table.rowsBetween(Window.unboundedPreceding, 0)
    inherited = F.coalesce(F.last(F.nullif("said", F.lit("")), ignorenulls=True).over(before), F.first("picked", ignorenulls=True).over(upto), F.lit(""))
    rows = rows.withColumn("description", F.coalesce("said", inherited))

    # Rows without a code go on with the description before them, if they hold nothing else.
    others = F.filter("cells", lambda c, i: (c != "") & (F.col("head.desc").isNull() | (i != F.col("head.desc"))))
    has_cell = F.col("head.desc").isNotNull() & (F.col("head.desc") < F.size("cells"))
    more = F.when(has_cell, F.when((F.size(others) == 0) & (text.norm_space(cell) != "") & ~text.norm_space(cell).rlike(_OTHER), text.norm_space(cell)))
    more = F.when(has_cell, more).otherwise(F.when(F.size(F.filter("cells", lambda c: c != "")) == 1, F.get(F.filter("cells", lambda c: c != ""), F.lit(0))))
    rows = rows.withColumn("more", F.when(F.col("code").isNull(), more)).withColumn("pos", F.count("code").over(by_page.rowsBetween(Window.unboundedPreceding, 0)))
    return _assembled(rows.where(F.col("pos") > 0), key)


def _assembled(rows: DataFrame, key: str) -> DataFrame:
    """One row per ``pos``: its code, and its description with what continues it in line order."""
    tail = F.transform(F.array_sort(F.collect_list(F.when(F.col("more").isNotNull(), F.struct("ln", "more")))), lambda x: x["more"])
    out = rows.groupBy(key, "pos").agg(F.max("code").alias("code"), F.max(F.when(F.col("code").isNotNull(), F.col("description"))).alias("d"), tail.alias("tail"))
    return out.select(key, "pos", "code", text.norm_space(F.concat_ws(" ", F.array(F.col("d")), F.col("tail"))).alias("description"))


def rows_from_lines(pages: DataFrame, key: str = "page_key", raw: str = "raw") -> DataFrame:
    """The same from plain lines: ``code description``; a bullet starts a prefix that following lines extend and
    that ``--`` entries after it carry; other lines continue the entry before them."""
    lines = _lines(pages, key, raw).withColumn("line", text.strip_emphasis(F.col("line"))).where(F.col("line") != "")
    entry = r"^([0-9]{2,4}(?:\.[0-9]{2,4}){1,4})[\p{IsWhite_Space}]*(.*)$"
    lines = lines.withColumn("code", F.nullif(codes.normalize_code(F.regexp_extract("line", entry, 1)), F.lit(""))).withColumn("rest", F.regexp_extract("line", entry, 2))
    dashed = F.ltrim("rest").startswith("--")
    undash = lambda c: text.norm_edges(text.strip_bullets(text.norm_edges(c)))
    uncolon = lambda c: text.norm_edges(F.rtrim(c, F.lit(":")))
    bullet = F.when(F.col("code").isNull() & F.col("line").rlike("^[-–—]"), uncolon(undash(F.col("line"))))
    lines = lines.withColumn("bullet", bullet).where(F.col("bullet").isNull() | (F.col("bullet") != ""))
    by_page = Window.partitionBy(key).orderBy("ln")
    upto = by_page.rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("dashed", dashed & F.col("code").isNotNull()).withColumn("group", F.sum((F.col("bullet").isNotNull() | (F.col("code").isNotNull() & ~F.col("dashed"))).cast("int")).over(upto))
    by_group = Window.partitionBy(key, "group").orderBy("ln")
    lines = lines.withColumn("pos", F.count("code").over(upto)).withColumn("led", F.max("bullet").over(Window.partitionBy(key, "group"))).withColumn("seen", F.count("code").over(by_group.rowsBetween(Window.unboundedPreceding, 0)))
    plain = F.col("code").isNull() & F.col("bullet").isNull()
    extends = plain & F.col("led").isNotNull() & (F.col("seen") == 0)
    parts = F.collect_list(F.when(F.col("bullet").isNotNull(), F.col("bullet")).when(extends, uncolon(F.col("line")))).over(by_group.rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("prefix", F.when(F.col("led").isNotNull(), text.norm_space(F.array_join(parts, " "))))
    desc = text.norm_space(undash(F.col("rest")))
    desc = F.when(F.col("dashed") & F.col("prefix").isNotNull() & (desc != ""), text.norm_space(F.concat_ws(" - ", "prefix", desc))).otherwise(desc)
    rows = lines.withColumn("description", F.when(F.col("code").isNotNull(), desc)).withColumn("more", F.when(plain & ~extends, F.col("line"))).where(F.col("pos") > 0)
    return _assembled(rows, key)


def extract_rows(pages: DataFrame, key: str = "page_key", raw: str = "raw") -> DataFrame:
    """(key, pos, code, description): table rows where a page has some, else rows of the line grammar."""
    tables = rows_from_tables(pages, key, raw)
    rest = pages.join(tables.select(key).distinct(), key, "left_anti")
    return tables.unionByName(rows_from_lines(rest, key, raw))


def page_range(pages: DataFrame, first: int | None = None, last: int | None = None, max_pages: int | None = None, max_files: int | None = None) -> DataFrame:
    """Pages of a range; of each file the first ``max_pages``, of all files the first ``max_files`` by name."""
    if first is not None:
        pages = pages.where(F.col("page") >= first)
    if last is not None:
        pages = pages.where(F.col("page") <= last)
    if max_files is not None:
        pages = pages.join(F.broadcast(pages.select("pdf").distinct().orderBy("pdf").limit(max_files)), "pdf", "left_semi")
    if max_pages is not None:
        pages = pages.withColumn("__n", F.dense_rank().over(Window.partitionBy("pdf").orderBy("page"))).where(F.col("__n") <= max_pages).drop("__n")
    return pages
