"""Line dedup by content-defined chunks, extended to every repeated passage of two lines or more.

The units are the chunks of ``line_dedup`` and all pairs: a line that is not blank, the next one that is not blank, and
the blank lines between them. A unit that stands at an earlier place of the corpus is removed. Chunks alone miss a
passage in which no two boundaries fall; the pairs extend them to its first and last line, whatever surrounds it. Lines
that repeat alone, between other neighbours, stay.

Units are counted by digest without their text, and the repeated ones are compared by their least and greatest bytes,
as chunks are in ``line_dedup``. Both aggregates combine before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from lexspark.llm.common import map_in_arrow, table, with_fields
from lexspark.llm.line_dedup import _repeatable, _row_key
from lexspark.session import Scratch


def pairs(lines: list[str]) -> list[tuple[int, int]]:
    """(first line, last line) of every pair."""
    full = [i for i, x in enumerate(lines) if x and not x.isspace()]
    return list(zip(full, full[1:]))


def units(lines: list[str]) -> list[tuple[int, int]]:
    """(first line, last line) of every pair and of every chunk that may be removed, each once."""
    return sorted({*pairs(lines), *((a, b - 1) for _, a, b, _ in _repeatable(lines))})


def _bytes(lines: list[str], a: int, b: int) -> bytes:
    return "\n".join(lines[a : b + 1]).encode()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: tuple[list, list, list, list, list] = ([], [], [], [], [])
        for doc_id, key, text in zip(*(b.column(i).to_pylist() for i in range(3))):
            if text and "\n" in text:
                lines = text.split("\n")
                for a, e in units(lines):
                    for column, value in zip(rows, (hashlib.md5(_bytes(lines, a, e)).digest(), doc_id, key, a, e)):
                        column.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[0], pa.binary()), pa.array(rows[1], b.schema.field(0).type), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.int32()), pa.array(rows[4], pa.int32())], names=["digest", "doc_id", "key", "line", "last"]
        )


def removed_lines(heads: dict[tuple[int, int], int]) -> set[int]:
    """``heads``: by first and last line of a repeated unit the first line of its head if that is in the same text,
    else -1. A head's own lines are not removed for its repeats, as where a line follows itself several times."""
    drop: set[int] = set()
    for (a, e), head in heads.items():
        if head != a:
            own = range(head, head + e - a + 1) if head >= 0 else ()
            drop.update(i for i in range(a, e + 1) if i not in own)
    return drop


def _split_documents(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` have ``hits``: (line, last, head) of their repeated units. Leaves what stays of the text in its column
    and adds n_lines, n_removed and repeated: (digest, bytes) of those units."""
    piece = StructType([StructField("digest", BinaryType()), StructField("bytes", BinaryType())])
    out = with_fields(docs.drop("hits"), n_lines=IntegerType(), n_removed=IntegerType(), repeated=ArrayType(piece))
    arrow_piece = pa.list_(pa.struct([("digest", pa.binary()), ("bytes", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, text_at = b.schema.get_field_index("hits"), b.schema.get_field_index(text)
            kept, n_lines, n_removed, repeated = [], [], [], []
            for t, found in zip(b.column(text_at).to_pylist(), b.column(at).to_pylist()):
                lines = [] if not t else t.split("\n")
                drop: set[int] = set()
                pieces = []
                if found:
                    heads = {(h["line"], h["last"]): h["head"] for h in found}
                    drop = removed_lines(heads)
                    for a, e in heads:
                        body = _bytes(lines, a, e)
                        pieces.append({"digest": hashlib.md5(body).digest(), "bytes": body})
                kept.append(t if not drop else "\n".join(x for i, x in enumerate(lines) if i not in drop))
                n_lines.append(len(lines))
                n_removed.append(len(drop))
                repeated.append(pieces)
            rest = [i for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(kept, pa.string()) if i == text_at else b.column(i) for i in rest), *(pa.array(x, pa.int32()) for x in (n_lines, n_removed)), pa.array(repeated, arrow_piece)],
                names=[*(b.schema.names[i] for i in rest), "n_lines", "n_removed", "repeated"],
            )

    return map_in_arrow(docs, run, out)


def dedup_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with what stays of the text in its column, and n_lines (of the whole text) and n_removed added;
    columns of these names are replaced.

    The head of a unit is its place with the smallest (id, MD5 of id and text, line); null ids come last. The first
    place of a line is never removed. Rows that agree in id and text are one document, null and empty texts stay, and
    a text that loses all its lines becomes empty, as in ``line_dedup``."""
    held = Scratch(docs.sparkSession)
    docs = docs.drop("n_lines", "n_removed", "repeated", "hits", "__key")
    keyed = docs.withColumn("__key", _row_key(doc_id, text))
    small = keyed.select(F.col(doc_id).alias("doc_id"), F.col("__key").alias("key"), F.col(text).alias("text"))
    id_type = keyed.schema[doc_id].dataType
    digests = map_in_arrow(small, _digests, StructType([StructField("digest", BinaryType()), StructField("doc_id", id_type), StructField("key", BinaryType()), StructField("line", IntegerType()), StructField("last", IntegerType())]))
    digests = held.table(digests, "unit-digests")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "line")
    repeated = digests.groupBy("digest").agg(F.min(place).alias("head"), F.max(place).alias("tail")).where(F.col("head") != F.col("tail")).select("digest", "head")
    repeated = held.table(repeated, "unit-repeats")
    while True:
        head = F.when(F.col("key") == F.col("head.key"), F.col("head.line")).otherwise(-1)
        hits = digests.join(repeated, "digest").select("key", F.struct("line", "last", head.alias("head")).alias("hit"))
        hits = held.table(hits.groupBy("key").agg(F.collect_set("hit").alias("hits")).withColumnRenamed("key", "__key"), "unit-hits")
        # No bound holds for the hits, so they are never broadcast.
        split = held.table(_split_documents(keyed.join(hits.hint("merge"), "__key", "left"), text), "unit-split")
        pieces = split.select(F.explode("repeated").alias("p")).select("p.*")
        unequal = pieces.groupBy("digest").agg(F.min("bytes").alias("least"), F.max("bytes").alias("most")).where(F.col("least") != F.col("most")).select("digest")
        if unequal.isEmpty():
            held.keep(split)
            return split.drop("__key", "repeated")
        # Different units with one digest: none of them counts as repeated.
        repeated = held.table(repeated.join(unequal, "digest", "left_anti"), "unit-repeats")


def op2_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``dedup_passages`` leaves of all documents; nulls, empty and repeated texts as described there."""
    docs = dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))
