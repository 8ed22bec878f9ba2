"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of the last lines decides where a chunk of lines ends, so that a passage falls into
the same chunks whatever stands before it. A chunk of two lines or more that occurs again anywhere in the corpus is
removed, but for its first occurrence, once its bytes have been compared.

The chunks' digests are counted without their text. Then every document is met once by the list of its repeated
chunks and split into the text that stays and the repeated chunks, which are compared by digest: their least and
greatest bytes must be equal. Both aggregates combine before they are shuffled, so a chunk in a third of all
documents costs no more than a rare one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from lexspark.llm.common import map_in_arrow, table, with_fields
from lexspark.session import materialise

#: Lines that the rolling hash spans, its base, and one line in so many ends a chunk.
WINDOW, BASE, ONE_IN = 2, 31, 4


def chunk_lines(lines: list[str]) -> list[tuple[int, int]]:
    """Chunks as (first line, line after the last)."""
    out, start, roll = [], 0, 0
    hashes = [int.from_bytes(hashlib.md5(x.encode()).digest()[:4], "big") for x in lines]
    top = BASE**WINDOW
    for i, h in enumerate(hashes):
        roll = roll * BASE + h - (hashes[i - WINDOW] * top if i >= WINDOW else 0)
        if (roll >> 7) % ONE_IN == 0:
            out.append((start, i + 1))
            start = i + 1
    if start < len(lines):
        out.append((start, len(lines)))
    return out


def _repeatable(lines: list[str]) -> list[tuple[int, int, int, bytes]]:
    """(index, first line, end, text) of the chunks that may be removed: two lines or more, not all blank."""
    found = []
    for k, (a, b) in enumerate(chunk_lines(lines)):
        if b - a >= 2:
            body = "\n".join(lines[a:b])
            if not body.isspace() and body:
                found.append((k, a, b, body.encode()))
    return found


def _row_key(doc_id: str, text: str):
    return F.unhex(F.md5(F.concat_ws("\x1f", F.coalesce(F.col(doc_id).cast("string"), F.lit("\x00")), F.coalesce(F.col(text), F.lit("\x00")))))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: tuple[list, list, list, list] = ([], [], [], [])
        for doc_id, key, text in zip(*(b.column(i).to_pylist() for i in range(3))):
            if text and "\n" in text:
                for k, _, _, body in _repeatable(text.split("\n")):
                    for column, value in zip(rows, (hashlib.md5(body).digest(), doc_id, key, k)):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.binary()), pa.array(rows[1], b.schema.field(0).type), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.int32())], names=["digest", "doc_id", "key", "chunk"])


def _split_documents(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` have ``hits``: (chunk, first) of their repeated chunks. Leaves what stays of the text in its column
    and adds n_lines, n_chunks, n_removed and repeated: (digest, bytes) of those chunks."""
    piece = StructType([StructField("digest", BinaryType()), StructField("bytes", BinaryType())])
    out = with_fields(docs.drop("hits"), n_lines=IntegerType(), n_chunks=IntegerType(), n_removed=IntegerType(), repeated=ArrayType(piece))
    arrow_piece = pa.list_(pa.struct([("digest", pa.binary()), ("bytes", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, text_at = b.schema.get_field_index("hits"), b.schema.get_field_index(text)
            hits = b.column(at).to_pylist()
            kept, n_lines, n_chunks, n_removed, repeated = [], [], [], [], []
            for t, found in zip(b.column(text_at).to_pylist(), hits):
                lines = [] if not t else t.split("\n")
                chunks = chunk_lines(lines)
                drop: set[int] = set()
                pieces = []
                if found:
                    first = {h["chunk"]: h["first"] for h in found}
                    for k, a, e, body in _repeatable(lines):
                        if k in first:
                            pieces.append({"digest": hashlib.md5(body).digest(), "bytes": body})
                            if not first[k]:
                                drop.update(range(a, e))
                kept.append(t if not drop else "\n".join(x for i, x in enumerate(lines) if i not in drop))
                n_lines.append(len(lines))
                n_chunks.append(len(chunks))
                n_removed.append(len(drop))
                repeated.append(pieces)
            rest = [i for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(kept, pa.string()) if i == text_at else b.column(i) for i in rest), *(pa.array(x, pa.int32()) for x in (n_lines, n_chunks, n_removed)), pa.array(repeated, arrow_piece)],
                names=[*(b.schema.names[i] for i in rest), "n_lines", "n_chunks", "n_removed", "repeated"],
            )

    return map_in_arrow(docs, run, out)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with what stays of the text in its column, and n_lines and n_chunks (of the whole text) and n_removed
    (lines) added; columns of these names are replaced.

    The first occurrence of a chunk is the one with the smallest (id, MD5 of id and text, place); null ids come
    last. Rows that agree in id and text are one document here: they keep and lose the same lines. A null text
    stays null and has no lines; an empty one stays as it is. A text that loses all its lines becomes empty."""
    docs = docs.drop("n_lines", "n_chunks", "n_removed", "repeated", "hits", "__key")
    keyed = docs.withColumn("__key", _row_key(doc_id, text))
    small = keyed.select(F.col(doc_id).alias("doc_id"), F.col("__key").alias("key"), F.col(text).alias("text"))
    id_type = keyed.schema[doc_id].dataType
    digests = map_in_arrow(small, _digests, StructType([StructField("digest", BinaryType()), StructField("doc_id", id_type), StructField("key", BinaryType()), StructField("chunk", IntegerType())]))
    digests = materialise(digests, "chunk-digests")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "chunk")
    repeated = digests.groupBy("digest").agg(F.min(place).alias("head"), F.max(place).alias("tail")).where(F.col("head") != F.col("tail")).select("digest", "head")
    repeated = materialise(repeated, "chunk-repeats")
    while True:
        hits = digests.join(repeated, "digest").select("key", F.struct("chunk", ((F.col("key") == F.col("head.key")) & (F.col("chunk") == F.col("head.chunk"))).alias("first")).alias("hit"))
        hits = materialise(hits.groupBy("key").agg(F.collect_set("hit").alias("hits")).withColumnRenamed("key", "__key"), "chunk-hits")
        # No bound holds for the hits, so they are never broadcast.
        split = materialise(_split_documents(keyed.join(hits.hint("merge"), "__key", "left"), text), "chunk-split")
        pieces = split.select(F.explode("repeated").alias("p")).select("p.*")
        unequal = pieces.groupBy("digest").agg(F.min("bytes").alias("least"), F.max("bytes").alias("most")).where(F.col("least") != F.col("most")).select("digest")
        if unequal.isEmpty():
            return split.drop("__key", "repeated")
        # Different chunks with one digest: none of them counts as repeated.
        repeated = materialise(repeated.join(unequal, "digest", "left_anti"), "chunk-repeats")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its lines, chunks and removed chunks, and the MD5 of the text that stays. A null text has
    no lines and the MD5 of the empty one, as has an empty text; a repeated row has the same result as the first; an
    empty table has no rows. Texts of any length are read whole."""
    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_chunks", "n_removed", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, text, md5(coalesce(doc_id::VARCHAR, chr(0)) || chr(31) || coalesce(text, chr(0))) AS key, row_number() OVER () AS r FROM documents
), x AS (
  SELECT r, doc_id, key, string_split(text, chr(10)) AS a FROM d WHERE text <> ''
), l AS (
  SELECT r, doc_id, key, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM x
), h AS (
  SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM l
), b AS (
  SELECT *, ((h + 31 * coalesce(lag(h) OVER (PARTITION BY r ORDER BY i), 0)) >> 7) % 4 = 0 AS ends FROM h
), k AS (
  SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS chunk FROM b
), c AS (
  SELECT r, doc_id, key, chunk, count(*) AS lines, min(i) AS first_i, string_agg(line, chr(10) ORDER BY i) AS body FROM k GROUP BY ALL
), o AS (
  SELECT *, lines >= 2 AND body NOT SIMILAR TO '\s*' AS may,
         first_value(key || '/' || chunk) OVER (PARTITION BY body ORDER BY doc_id NULLS LAST, key, chunk) AS head
  FROM c
), v AS (
  SELECT r, sum(lines)::INT AS n_lines, count(*)::INT AS n_chunks,
         coalesce(sum(lines) FILTER (may AND head <> key || '/' || chunk), 0)::INT AS n_removed,
         md5(coalesce(string_agg(body, chr(10) ORDER BY first_i) FILTER (NOT (may AND head <> key || '/' || chunk)), '')) AS kept_md5
  FROM o GROUP BY r
)
SELECT doc_id, coalesce(n_lines, 0)::INT AS n_lines, coalesce(n_chunks, 0)::INT AS n_chunks, coalesce(n_removed, 0)::INT AS n_removed, coalesce(kept_md5, md5('')) AS kept_md5
FROM d LEFT JOIN v USING (r)
"""
