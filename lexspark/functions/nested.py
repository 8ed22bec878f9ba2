"""JSON, maps and arrays: lenient parsing, usage tallies, validation of returned rows, batching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.session import materialise


def lenient_json(c: Column) -> Column:
    """A JSON value (variant): the text itself, else what stands between its first and last brace; a bare list is
    wrapped as {"rows": list}; null if nothing parses."""
    text = F.trim(c)
    wrapped = F.when(F.startswith(text, F.lit("[")), F.concat(F.lit('{"rows":'), text, F.lit("}"))).otherwise(text)
    inner = F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.coalesce(F.try_parse_json(wrapped), F.try_parse_json(inner))


def usage_map(c: Column) -> Column:
    """Token counts of a usage object under whatever names they come; missing ones are 0."""
    get = lambda *names: F.coalesce(*[F.get_json_object(c, f"$.{n}").cast("long") for n in names], F.lit(0).cast("long"))
    prompt, completion = get("prompt_tokens", "promptTokenCount", "prompt_token_count"), get("completion_tokens", "candidatesTokenCount", "candidates_token_count")
    total = F.coalesce(*[F.get_json_object(c, f"$.{n}").cast("long") for n in ("total_tokens", "totalTokenCount", "total_token_count")], prompt + completion)
    return F.create_map(F.lit("prompt_tokens"), prompt, F.lit("completion_tokens"), completion, F.lit("total_tokens"), total)


def add_maps(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def tally(df: DataFrame, usage: str) -> DataFrame:
    """(key, n): additive totals over a map column."""
    return df.select(F.explode(usage).alias("key", "n")).groupBy("key").agg(F.sum("n").alias("n"))


def same_codes(before: Column, after: Column) -> Column:
    """Rows that came back as they went: as many, with the same codes in the same order."""
    pairs = F.zip_with(before, after, lambda x, y: x["code"].eqNullSafe(y["code"]))
    return (F.size(before) == F.size(after)) & F.forall(pairs, lambda ok: ok)


def same_ids(asked: Column, got: Column) -> Column:
    return (F.size(F.array_except(asked, got)) == 0) & (F.size(F.array_except(got, asked)) == 0)


def valid_updates(targets: Column, updates: Column) -> Column:
    """Updates (index, code) cover all targets (index, code), each once, with its code unchanged."""
    index = F.transform(updates, lambda u: u["index"])
    return same_ids(F.transform(targets, lambda t: t["index"]), index) & (F.size(index) == F.size(F.array_distinct(index))) & (F.size(F.array_except(updates, targets)) == 0)


def with_batches(df: DataFrame, order: str | tuple[str, ...], size: int, partition: str | None = None, name: str = "batch") -> DataFrame:
    """Batch numbers of ``size`` rows in order; a size of 0 or less is one batch. With ``partition``, batches are
    numbered in each of its values. Without, rows are put into ranges of ``order`` in a shared table and numbered in
    each range, after the rows of the ranges before it; columns that tell ties apart let a frequent value be spread."""
    order = (order,) if isinstance(order, str) else order
    if size <= 0:
        return df.withColumn(name, F.lit(0).cast("long"))
    if partition:
        return df.withColumn(name, F.floor((F.row_number().over(Window.partitionBy(partition).orderBy(*order)) - 1) / size))
    ranges = materialise(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = {r["__range"]: r["count"] for r in ranges.groupBy("__range").count().collect()}  # a row for each shuffle partition
    before = [sum(n for k, n in sizes.items() if k < at) for at in range(max(sizes, default=0) + 1)]
    first = F.element_at(F.array(*[F.lit(n).cast("long") for n in before]), F.col("__range") + 1)
    number = first + F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return ranges.withColumn(name, F.floor(number / size)).drop("__range")
