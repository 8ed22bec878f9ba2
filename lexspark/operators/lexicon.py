"""The product lexicon: tokens by product, how telling they are, and which product a query means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import text
from lexspark.operators.gate import match_threshold, similar_tokens


def product_tokens(entries: DataFrame, product: str = "id", keywords: str = "keywords") -> DataFrame:
    """(product, token): the tokens of a product's name and keywords."""
    every = F.concat_ws(" ", F.array(F.col(product)), F.coalesce(F.col(keywords), F.array().cast("array<string>")))
    return entries.where(F.trim(F.coalesce(F.col(product), F.lit(""))) != "").select(F.col(product).alias("product"), F.explode(text.tokens(every)).alias("token")).distinct()


def token_idf(tokens: DataFrame) -> DataFrame:
    """(token, df, idf) over products; always positive."""
    n = tokens.agg(F.countDistinct("product").alias("n"))
    df = tokens.groupBy("token").agg(F.countDistinct("product").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("token", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def token_matches(queries: DataFrame, tokens: DataFrame, query_id: str = "query_id", query: str = "query", fuzzy: bool = True) -> DataFrame:
    """(query_id, product, qt, pt): pairs of a query's and a product's tokens that match, exactly or alike. Alike
    counts for tokens of four characters or more."""
    q = queries.select(F.col(query_id).alias("query_id"), text.query_tokens(query).alias("qts")).withColumn("n", F.size("qts"))
    qx = q.select("query_id", "n", F.explode("qts").alias("qt"))
    exact = qx.join(tokens.withColumnRenamed("token", "pt"), F.col("qt") == F.col("pt")).select("query_id", "product", "qt", "pt", F.lit(True).alias("exact"))
    if not fuzzy:
        return exact
    alike = similar_tokens(qx.where(F.length("qt") >= 4), tokens.where(F.length("token") >= 4).select(F.col("token").alias("ct")), at_least=0.8).where(F.col("qt") != F.col("ct"))
    near = qx.join(alike, "qt").where(F.col("similarity") >= match_threshold(F.col("n"), F.col("qt"), F.col("ct")))
    near = near.join(tokens.select("product", F.col("token").alias("ct")), "ct").select("query_id", "product", "qt", F.col("ct").alias("pt"), F.lit(False).alias("exact"))
    return exact.unionByName(near)


def best_product(matches: DataFrame, idf: DataFrame, min_idf: float = 1.4, min_lead: float = 0.75) -> DataFrame:
    """(query_id, product, weight): the product whose matched tokens weigh most, of ties the first by name; none if
    its best token is common and the next product is close. Where tokens match exactly, alike ones don't count."""
    w = Window.partitionBy("query_id", "product")
    matches = matches.withColumn("any_exact", F.max("exact").over(w)).where(F.col("exact") | ~F.col("any_exact")).select("query_id", "product", "pt").distinct()
    weighed = matches.join(idf.select(F.col("token").alias("pt"), "idf"), "pt", "left").withColumn("idf", F.coalesce("idf", F.lit(1.0)))
    per = weighed.groupBy("query_id", "product").agg(F.sum("idf").alias("weight"), F.max("idf").alias("top"))
    by_weight = Window.partitionBy("query_id").orderBy(F.col("weight").desc(), "product")
    per = per.withColumn("n", F.row_number().over(by_weight)).withColumn("next", F.coalesce(F.lead("weight").over(by_weight), F.lit(0.0)))
    return per.where((F.col("n") == 1) & ((F.col("top") >= min_idf) | (F.col("weight") - F.col("next") >= min_lead))).select("query_id", "product", "weight")
