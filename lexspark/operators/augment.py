"""Rewriting and keywords from an external provider, kept in a cache by id: what is missing, how it is asked for in
batches, how answers are merged and applied."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import nested, text
from lexspark.session import Scratch
from lexspark.sources.sinks import AnswerJournal, CacheStore

MODES = ("short", "keywords", "all")
ANSWER = "id string, augmented_description string, keywords array<string>"
#: Tasks of one job that asks, each with a batch.
MAX_TASKS = 10_000
#: Takes items (dicts with an id) and returns one answer for each: {"id", "augmented_description", "keywords"}.
Provider = Callable[[list[dict]], list[dict]]


def _present(keywords: str) -> Column:
    return F.coalesce(F.size(keywords) > 0, F.lit(False))


def pending(objects: DataFrame, cache: DataFrame, mode: str = "keywords", threshold: int = 80, force: bool = False) -> DataFrame:
    """Objects (id, description, ...) for which the cache (id, augmented_description, keywords) lacks something
    that the mode wants; adds need_rewrite."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    rewrite = F.lit(True) if mode == "all" else text.needs_description_rewrite("description", threshold)
    rows = objects.where(F.coalesce("id", F.lit("")) != "").withColumn("need_rewrite", rewrite)
    if mode == "short":
        rows = rows.where("need_rewrite")
    if force:
        return rows
    held = cache.select("id", (F.trim(F.coalesce("augmented_description", F.lit(""))) != "").alias("__aug"), _present("keywords").alias("__kw"))
    # Short mode has only rows that need rewriting by now, so all modes want keywords here.
    enough = F.col("__kw") & (~F.col("need_rewrite") | F.col("__aug"))
    return rows.join(held, "id", "left").where(~F.coalesce(enough, F.lit(False))).drop("__aug", "__kw")


def pending_keywords(objects: DataFrame, cache: DataFrame) -> DataFrame:
    """Objects without keywords in the cache."""
    return objects.join(cache.where(_present("keywords")).select("id"), "id", "left_anti")


def halving(provider: Provider, fallback: Provider, items: list[dict]) -> list[dict]:
    """Answers for all items: a batch that fails or returns other ids is halved, down to single items; a single one
    that fails twice gets the fallback."""
    stack, out = [items], []
    while stack:
        part = stack.pop()
        for _ in range(1 if len(part) > 1 else 2):
            try:
                got = provider(part)
                if sorted(r["id"] for r in got) == sorted(r["id"] for r in part):
                    out += got
                    break
            except Exception:  # noqa: BLE001, S112 - whatever a provider raises, the batch is tried in parts
                continue
        else:
            if len(part) > 1:
                stack += [part[len(part) // 2 :], part[: len(part) // 2]]
            else:
                out += fallback(part)
    return out


def ask(items: DataFrame, provider: Provider, fallback: Provider, batch_size: int = 20) -> DataFrame:
    """Answers (id, augmented_description, keywords) of a provider that is called with batches inside the tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = frame.to_dict("records")
            for at in range(0, len(rows), batch_size):
                got = halving(provider, fallback, rows[at : at + batch_size])
                yield pd.DataFrame({"id": [r["id"] for r in got], "augmented_description": [r.get("augmented_description") for r in got], "keywords": [list(r.get("keywords") or []) for r in got]})

    return items.mapInPandas(run, ANSWER)


#: Batches are numbered in so many groups by id, so that no task numbers them all.
NUMBER_GROUPS = 256


def batched(items: DataFrame, batch_size: int) -> tuple[DataFrame, int]:
    """``items`` with their batch (0, 1, ...), and the number of batches: ``batch_size`` items each, the last may have
    fewer. Items are ranked in groups by hash; the driver adds up the groups' sizes."""
    rows = items.withColumn("__group", F.pmod(F.xxhash64("id"), F.lit(NUMBER_GROUPS)).cast("int"))
    sizes = {r["__group"]: r["count"] for r in rows.groupBy("__group").count().collect()}  # NUMBER_GROUPS rows
    before = [sum(n for g, n in sizes.items() if g < k) for k in range(NUMBER_GROUPS + 1)]
    first = F.element_at(F.array(*[F.lit(n).cast("long") for n in before]), F.col("__group") + 1)
    number = first + F.row_number().over(Window.partitionBy("__group").orderBy("id")) - 1
    return rows.withColumn("batch", F.floor(number / batch_size).cast("int")).drop("__group"), -(-before[-1] // batch_size)


def ask_once(items: DataFrame, journal: AnswerJournal, provider: Provider, fallback: Provider, batch_size: int = 20, parallel: int | None = None, pause: float = 0.0, calls_per_task: int = 1) -> DataFrame:
    """Answers to ``items`` (id, ...) from a journal; a provider is asked for those that aren't in it.

    A batch is a task, and what it answers is in the journal when the task ends, before anything reads it: no other
    batch is asked for again if a task is retried or the job fails, and a rerun asks for what has no answer yet. Where
    calls are cheap a task may make several (``calls_per_task``), which are then lost together. With ``parallel``, jobs of that many tasks follow one another, so that the cluster never makes more calls at once, and
    each call is followed by ``pause`` seconds. Rows that repeat an id are asked for once; a null id isn't."""
    held = Scratch(items.sparkSession)
    known = journal.read(ANSWER)
    rows = items.where(F.col("id").isNotNull()).dropDuplicates(["id"])
    rows, n = batched(held.table(rows.join(known.select("id"), "id", "left_anti"), "to-ask"), batch_size * calls_per_task)
    rows = held.table(rows, "batches")

    def paced(part: list[dict]) -> list[dict]:
        try:
            return provider(part)
        finally:
            time.sleep(pause)

    at_once = min(parallel or MAX_TASKS, MAX_TASKS)
    for first in range(0, n, at_once):
        wave = rows.where(F.col("batch").between(first, first + at_once - 1))
        wave = wave.repartitionById(min(at_once, n - first), F.col("batch") - first).drop("batch")
        journal.append(ask(wave, paced if pause else provider, fallback, batch_size))
    answers = held.table(items.select("id").distinct().join(journal.read(ANSWER), "id"), "answers")
    held.keep(answers)
    return answers


#: Takes a page's targets (dicts with index, code, description) and returns updates of the same kind.
Improver = Callable[[list[dict]], list[dict]]


def improve_rows(rows: DataFrame, improver: Improver, page: tuple[str, ...] = ("pdf", "page"), pos: str = "pos") -> DataFrame:
    """``rows`` (page columns, pos, country, code, description) with better descriptions where a row needs one and the
    improver gives some. It is called once a page, inside the tasks. A page's updates count only if they cover all of
    its targets, each once and with its code unchanged; else, and where the call fails, the page stays as it was."""
    target = F.struct(F.col(pos).cast("int").alias("index"), F.coalesce("code", F.lit("")).alias("code"), F.coalesce("description", F.lit("")).alias("description"))
    asked = rows.where(text.needs_rewrite_row("code", "description", "country")).groupBy(*page).agg(F.sort_array(F.collect_list(target)).alias("targets"))
    names = [f.name for f in asked.schema.fields if f.name != "targets"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = []
            for targets in frame["targets"]:
                try:
                    updates = improver([dict(t) for t in targets])
                    got.append([{"index": int(u["index"]), "code": str(u["code"]), "description": str(u["description"])} for u in updates])
                except Exception:  # noqa: BLE001 - whatever an improver raises, the page stays as it was
                    got.append([])
            yield frame.assign(updates=got)

    item = "array<struct<index:int,code:string,description:string>>"
    kinds = ", ".join(f"`{c}` {asked.schema[c].dataType.simpleString()}" for c in names)
    answered = asked.mapInPandas(run, f"{kinds}, targets {item}, updates {item}")
    pair = lambda c: F.transform(c, lambda x: F.struct(x["index"].alias("index"), x["code"].alias("code")))
    good = answered.where(nested.valid_updates(pair("targets"), pair("updates"))).select(*page, F.explode("updates").alias("u"))
    good = good.select(*page, F.col("u.index").alias(pos), text.norm_space("u.description").alias("__better"))
    return rows.join(good, [*page, pos], "left").withColumn("description", F.coalesce("__better", "description")).select(*rows.columns)


#: Takes a page's country (or None), the beginning of its text and its rows (dicts with code, description), and returns
#: as many rows with the same codes in the same order.
Normaliser = Callable[[str | None, str, list[dict]], list[dict]]
#: Fixed value: characters of a page's text that a normaliser gets as context.
CONTEXT_LENGTH = 8000


def normalise_rows(rows: DataFrame, normaliser: Normaliser, texts: DataFrame | None = None, page: tuple[str, ...] = ("pdf", "page"), pos: str = "pos", context_length: int = CONTEXT_LENGTH) -> DataFrame:
    """``rows`` (page columns, pos, country, code, description, ...) with all descriptions of a page as the normaliser
    gives them; ``texts`` (page columns, raw) are the pages' texts. It is called once a page, inside the tasks, and what
    it says is written before anything reads it. A page's rows count only if they are as many with the same codes in
    the same order; else, and where the call fails, the page stays as it was.

    Rows of one ``pos`` are taken by code and description. Null codes and descriptions are given as empty ones. Pages
    whose page columns hold a null are not asked about. Without rows nothing is asked."""
    order = (F.col(pos), F.coalesce("code", F.lit("")), F.coalesce("description", F.lit("")))
    known = F.lit(True)
    for c in page:
        known = known & F.col(c).isNotNull()
    held = Scratch(rows.sparkSession)
    numbered = held.table(rows.withColumn("__n", F.row_number().over(Window.partitionBy(*page).orderBy(*order))), "page-rows")
    row = F.struct(F.col("__n").alias("n"), order[1].alias("code"), order[2].alias("description"))
    said = lambda c: F.transform(c, lambda x: F.struct(x["code"].alias("code"), x["description"].alias("description")))
    asked = numbered.where(known).groupBy(*page).agg(F.max("country").alias("__country"), said(F.sort_array(F.collect_list(row))).alias("__before"))
    if texts is None:
        asked = asked.withColumn("__raw", F.lit(""))
    else:
        first = texts.groupBy(*page).agg(F.min("raw").alias("__raw"))
        asked = asked.join(first, [*page], "left").withColumn("__raw", F.substring(F.coalesce("__raw", F.lit("")), 1, context_length))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = []
            for country, raw, before in zip(frame["__country"], frame["__raw"], frame["__before"]):
                try:
                    out = normaliser(None if pd.isna(country) else country, raw, [dict(r) for r in before])
                    got.append([{"code": str(r.get("code") or "").strip(), "description": str(r.get("description") or "").strip()} for r in out])
                except Exception:  # noqa: BLE001 - whatever a normaliser raises, the page stays as it was
                    got.append(None)
            yield frame.drop(columns=["__country", "__raw"]).assign(__after=got)

    item = "array<struct<code:string,description:string>>"
    kinds = ", ".join(f"`{c}` {asked.schema[c].dataType.simpleString()}" for c in page)
    answered = held.table(asked.mapInPandas(run, f"{kinds}, __before {item}, __after {item}"), "normalised")
    good = answered.where(nested.same_codes(F.col("__before"), F.col("__after"))).select(*page, F.posexplode("__after").alias("__at", "__row"))
    good = good.select(*page, (F.col("__at") + 1).alias("__n"), text.norm_space("__row.description").alias("__better"))
    both = numbered.join(good, [*page, "__n"], "left")
    return both.withColumn("description", F.coalesce("__better", "description")).select(*rows.columns)


def refresh(store: CacheStore, objects: DataFrame, provider: Provider, fallback: Provider, mode: str = "keywords", batch_size: int = 20, rounds: int = 1, parallel: int | None = None, pause: float = 0.0, calls_per_task: int = 1) -> DataFrame:
    """Everything that keeps a cache up to date: what is pending for ``objects`` (id, description) is asked for in
    batches, merged and stored as a new version. With several ``rounds``, that many parts by id are stored one after
    another. Answers go to the journal of the version to come first (``ask_once``, which takes ``parallel``, ``pause`` and
    ``calls_per_task``), so a run that breaks off keeps all of them. Returns the current cache."""
    spark = objects.sparkSession
    empty = spark.createDataFrame([], ANSWER)
    for part in range(rounds):
        held = store.read()
        cache = empty if held is None else held
        todo = pending(objects.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == part), cache, mode)
        answers = ask_once(todo.select("id", "description"), store.journal(), provider, fallback, batch_size, parallel, pause, calls_per_task)
        store.write(merge_cache(cache, answers))
    return store.read()


def default_answers(items: DataFrame, kind: str = "objects") -> DataFrame:
    """Answers without a model: keywords from the items' own texts, no rewriting. Native columns. Items are ``objects``
    (id, description; context, the descriptions above it, if there is such a column), ``terms`` (id, term) or
    ``attributes`` (id, product, attribute_type, attribute_value, text)."""
    if kind == "objects":
        keywords = text.fallback_keywords("description", context=F.col("context") if "context" in items.columns else None)
    elif kind == "terms":
        keywords = text.term_keywords("term", "id")
    elif kind == "attributes":
        keywords = text.attribute_keywords("product", "attribute_type", "attribute_value", "text")
    else:
        raise ValueError("kind must be objects, terms or attributes")
    return items.select("id", F.lit(None).cast("string").alias("augmented_description"), keywords.alias("keywords"))


def merge_cache(cache: DataFrame, answers: DataFrame, overwrite: bool = False) -> DataFrame:
    """The cache with the answers: an empty answer keeps what was there unless ``overwrite``."""
    old = cache.select("id", F.col("augmented_description").alias("__a"), F.col("keywords").alias("__k"))
    new = answers.select("id", F.nullif(text.norm_space("augmented_description"), F.lit("")).alias("a"), "keywords", F.lit(True).alias("__new"))
    both = old.join(new, "id", "full_outer")
    isnew = F.coalesce("__new", F.lit(False))
    if overwrite:
        description, keywords = F.when(isnew, F.col("a")).otherwise(F.col("__a")), F.when(isnew, F.col("keywords")).otherwise(F.col("__k"))
    else:
        description = F.coalesce("a", "__a")
        keywords = F.when(F.coalesce(F.size("keywords") > 0, F.lit(False)) | F.col("__k").isNull(), F.col("keywords")).otherwise(F.col("__k"))
    return both.select("id", description.alias("augmented_description"), F.when(isnew, text.clean_keywords(keywords, 12)).otherwise(keywords).alias("keywords"))


def normalise_cache_ids(cache: DataFrame) -> DataFrame:
    """Entries under old ids move to the current ones; where both exist the one with more keywords stays, of equal
    ones the old id's."""
    n = F.coalesce(F.size("keywords"), F.lit(0))
    c = cache.withColumn("__id", text.cache_id("id")).withColumn("__old", F.col("__id") != F.col("id"))
    best = c.groupBy("__id").agg(F.max_by(F.struct("augmented_description", "keywords"), F.struct(n, F.col("__old").cast("int"))).alias("r"))
    return best.select(F.col("__id").alias("id"), "r.*")


def apply_cache(objects: DataFrame, cache: DataFrame, national: bool = False) -> DataFrame:
    """Objects with description, keywords and search text from the cache; those without an entry keep theirs."""
    c = cache.select("id", F.col("augmented_description").alias("__a"), F.col("keywords").alias("__k"), F.lit(True).alias("__hit"))
    j = objects.join(c, "id", "left")
    hit = F.coalesce("__hit", F.lit(False))
    described = text.norm_space(F.coalesce(F.nullif("__a", F.lit("")), F.col("description")))
    j = j.withColumn("description", F.when(hit, described).otherwise(F.col("description"))).withColumn("keywords", F.when(hit, text.clean_keywords(F.col("__k"), 12)).otherwise(F.col("keywords")))
    parts = (["country"] if national else []) + ["code", "digits", "description"]
    return j.withColumn("text", text.search_text(*parts, keywords=F.col("keywords"))).drop("__a", "__k", "__hit")


def apply_terms(triples: DataFrame, cache: DataFrame, products: DataFrame, types: DataFrame, limit: int = 20) -> DataFrame:
    """Triples (id, product, attribute_type, text, keywords) with the keywords of their product, their type and
    their own, in that order. Own keywords from the cache are cleaned, and so is then all of the list; without an
    entry words are only made unique. ``products`` and ``types``: (term, keywords)."""
    terms = lambda t, key, name: t.select(F.col("term").alias(key), F.col("keywords").alias(name))
    j = triples.withColumn("__p", text.norm_space("product")).withColumn("__t", text.norm_space("attribute_type"))
    j = j.join(terms(products, "__p", "__pk"), "__p", "left").join(terms(types, "__t", "__tk"), "__t", "left")
    j = j.join(cache.select("id", F.col("keywords").alias("__ck"), F.lit(True).alias("__hit")), "id", "left")
    none = F.array().cast("array<string>")
    hit = F.coalesce("__hit", F.lit(False))
    own = F.when(hit, text.clean_keywords(F.col("__ck"), limit)).otherwise(F.coalesce("keywords", none))
    every = F.concat(F.coalesce("__pk", none), F.coalesce("__tk", none), own)
    plain = text.stable_distinct(F.filter(F.transform(every, text.norm_space), lambda x: x != ""), limit)
    j = j.withColumn("keywords", F.when(hit, text.clean_keywords(every, limit)).otherwise(plain))
    return j.withColumn("text", text.search_text("text", keywords=F.col("keywords"))).drop("__p", "__t", "__pk", "__tk", "__ck", "__hit")
