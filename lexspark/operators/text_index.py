"""A stored inverted index for BM25: a search reads the postings of its words, not the texts.

The postings of a token are cut into blocks of similar weight, each with its greatest one, and lie in folders by a hash
of the token. A search first reads the heaviest blocks; their kth score then says which other blocks it can skip: those
whose greatest weight, with all that the query's other tokens could add, stays below.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions import text
from lexspark.operators import retrieve
from lexspark.session import Scratch

#: Folders of tokens, postings of a block, steps of weight between blocks, and postings of a token that are read first.
BUCKETS, BLOCK_POSTINGS, STEPS, HEAD_POSTINGS = 64, 4_096, 16, 64
#: Postings of a folder that one task writes, beside those of large tokens.
SLICE_POSTINGS = 4_000_000
#: Scores count to so many digits; ties go to the smaller id.
DIGITS = 6


@dataclass(frozen=True)
class TextIndex:
    spark: SparkSession
    path: str
    n_docs: int
    id_type: str = "bigint"

    def blocks(self) -> DataFrame:
        """(token, head, most, ids, weights, bucket): weights are BM25 without the token's own worth."""
        return self.spark.read.schema(f"token string, head boolean, most double, ids array<{self.id_type}>, weights array<double>, bucket int").parquet(f"{self.path}/blocks")

    def tokens(self) -> DataFrame:
        """(token, df, most, bucket): no weight of the token reaches ``most``."""
        return self.spark.read.schema("token string, df bigint, most double, bucket int").parquet(f"{self.path}/tokens")


def _bucket(token: str) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def counted(docs: DataFrame, doc_id: str, body: str) -> DataFrame:
    """(doc_id, dl, words): of each text its different words with how often they occur, found in the row without a
    shuffle: the words are sorted, and a word's run ends where the next one begins."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.sort_array(F.coalesce(retrieve.words(F.col(body)), F.array().cast("array<string>"))).alias("w"))
    d = d.withColumn("at", F.filter(F.transform("w", lambda x, i: F.when((i == 0) | (F.get("w", i - 1) != x), i)), lambda i: i.isNotNull()))
    ends = F.concat(F.slice("at", F.lit(2), F.size("at")), F.array(F.size("w")))
    words = F.zip_with("at", ends, lambda i, j: F.when(j.isNotNull() & i.isNotNull(), F.struct(F.get("w", i).alias("token"), (j - i).alias("tf"))))
    return d.select("doc_id", F.size("w").alias("dl"), F.filter(words, lambda x: x.isNotNull()).alias("words"))


def build(docs: DataFrame, path: str, doc_id: str = "doc_id", body: str = "text", k1: float = retrieve.K1, b: float = retrieve.B) -> TextIndex:
    """Index every row of ``docs`` under ``path``, which must be new. Texts are read once; a null text has no tokens but
    counts as a document. Ids are unique.

    What is kept between is one row for each text with its counted words. Postings are shuffled once: to the part of the
    folder that they are written to, where their blocks are cut. Tokens with more than a block are the few that are
    dealt by ids too, so no task holds all postings of one."""
    spark, held = docs.sparkSession, Scratch(docs.sparkSession)
    texts = held.table(counted(docs, doc_id, body), "counted")
    n_docs, total, n_postings = texts.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0)), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    average = max(total, 1) / max(n_docs, 1)
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(float(average))))
    level = F.floor(weight * STEPS).cast("int")
    rows = texts.select("doc_id", "dl", F.inline("words"))
    # A step is a power of two, so a weight is below the next step exactly.
    tokens = rows.groupBy("token").agg(F.count("*").alias("df"), F.max(level).alias("level"))
    tokens = held.table(tokens.select("token", "df", ((F.col("level") + 1) / STEPS).alias("most")), "tokens")
    tokens.withColumn("bucket", _bucket("token")).repartition("bucket").sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{path}/tokens")
    # At most one token in BLOCK_POSTINGS postings; Spark broadcasts them while they are small.
    large = held.table(tokens.where(F.col("df") > BLOCK_POSTINGS).select("token", F.ceil(F.col("df") / BLOCK_POSTINGS).alias("parts")), "large")
    slices = max(1, -(-n_postings // (BUCKETS * SLICE_POSTINGS)))
    of_folder = F.pmod(F.xxhash64("token", F.lit(1)), F.lit(slices)).cast("int")
    cut = rows.join(large, "token", "left").select("token", "doc_id", "tf", "dl", _bucket("token").alias("bucket"), of_folder.alias("slice"), F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    dealt = ["bucket", "slice", "part"]
    blocks = cut.repartition(*dealt).withColumn("weight", weight).groupBy(*dealt, "token", level.alias("level")).agg(F.max("weight").alias("most"), F.collect_list(F.struct("doc_id", "weight")).alias("rows"))
    heavier = F.coalesce(F.sum(F.size("rows")).over(Window.partitionBy(*dealt, "token").orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("token", ((F.col("part") == 0) & (heavier < HEAD_POSTINGS)).alias("head"), "most", F.col("rows.doc_id").alias("ids"), F.col("rows.weight").alias("weights"), "bucket")
    blocks.sortWithinPartitions("bucket", "token").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/blocks")
    meta = {"n_docs": n_docs, "id_type": docs.schema[doc_id].dataType.simpleString()}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.text(f"{path}/meta")
    held.keep()
    return TextIndex(spark, path, **meta)


def open_index(spark: SparkSession, path: str) -> TextIndex:
    return TextIndex(spark, path, **json.loads(spark.read.text(f"{path}/meta").first()[0]))


def worth(index: TextIndex, queries: DataFrame, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """(query_id, token, bucket, idf, others): what a query's tokens are worth, and what its other tokens add at most."""
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(text.tokens(query)).alias("token"))
    idf = F.log(1 + (F.lit(float(index.n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = asked.join(index.tokens(), "token").withColumn("idf", idf)
    cap = F.col("idf") * F.col("most")
    return known.select("query_id", "token", "bucket", "idf", (F.sum(cap).over(Window.partitionBy("query_id")) - cap).alias("others"))


def live_blocks(index: TextIndex, asked: DataFrame) -> DataFrame:
    """The blocks of ``asked`` (as from ``worth``, with ``kth``) whose documents may have that score; only the folders
    of its tokens are read."""
    buckets = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # at most BUCKETS
    blocks = index.blocks().where(F.col("bucket").isin(buckets)).drop("bucket")
    enough = F.col("idf") * F.col("most") + F.col("others") >= F.col("kth") - 2 * 10.0**-DIGITS
    return asked.drop("bucket").join(blocks, "token").where(F.col("kth").isNull() | enough)


def _scored(blocks: DataFrame) -> DataFrame:
    each = blocks.select("query_id", "idf", F.inline(F.arrays_zip("ids", "weights")))
    return each.groupBy("query_id", F.col("ids").alias("doc_id")).agg(F.round(F.sum(F.col("idf") * F.col("weights")), DIGITS).alias("score"))


def search(index: TextIndex, queries: DataFrame, k: int, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """(query_id, doc_id, score, rank): the ``k`` best documents by BM25 to ``DIGITS`` digits, ties to the smaller id;
    the same as a comparison with all documents, whatever is skipped. Ids of queries are unique."""
    held = Scratch(index.spark)
    asked = held.table(worth(index, queries, query_id, query), "asked")
    # What the heaviest blocks give is at most a document's score, so its kth best is a bound.
    first = retrieve.top_k(_scored(live_blocks(index, asked.withColumn("kth", F.lit(None).cast("double"))).where("head")), k)
    kth = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    best = retrieve.top_k(_scored(live_blocks(index, held.table(asked.join(kth, "query_id", "left"), "bounds"))), k)
    out = held.table(best.select("query_id", "doc_id", "score", "rank"), "text-best")
    held.keep(out)
    return out
