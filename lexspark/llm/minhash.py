"""Near-duplicates by b-bit MinHash.

1. Every text becomes the set of its word shingles; of the set, minima under many hash functions. Bands of minima
   are hashed to buckets, and the lowest bits of all minima are packed into a few longs.
2. Texts of the same words form a class (by SHA-256 of the words), so copies never meet as pairs.
3. The hub of a bucket is the class that shares most buckets with others; each class is compared with the weightiest
   hub of its buckets. A pair first needs sizes that allow the similarity, then an estimate from its packed bits,
   corrected for minima that agree in these bits by chance. What remains is decided on the full sets of word shingles.
   The classes outside their bucket's largest component then choose hubs among themselves, as long as that links many.
4. Buckets whose classes are one component by then are done. In small ones, the classes outside the largest component
   are compared with all of the bucket. In large ones, every class is written as its difference from a hub, one for
   all buckets whose hubs are one component (shingles that only one of the two has). Two classes that aren't both
   linked to the hub can only be similar if their differences share so many elements that they share one of the
   rarest few; only classes that do are compared.

A large group of near copies thus costs a pair a member, and copies that were each changed on their own don't meet:
what they have in common is common with the hub. No bucket has a cap, and no pair of a bucket is left undecided.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, LongType, StructField, StructType

from lexspark.llm.common import map_in_arrow, table
from lexspark.llm.components import components
from lexspark.llm.polyhash import BASE, U, mix
from lexspark.session import Scratch

#: 38 bands of 5 minima: at a similarity of 0.8 a pair shares no band with a chance of 3e-7.
BANDS, BAND_ROWS, BITS = 38, 5, 2
#: The bands take the first minima, the estimate takes all.
MINIMA = 448
LONGS = -(-MINIMA * BITS // 64)
#: The estimate's standard error at 0.8 is 0.0225; pairs this far under the threshold are still checked in full, so
#: that a pair at the threshold is missed with a chance of 5e-6.
MARGIN = 0.1
#: Buckets of so many classes are small.
SMALL = 16
#: Hubs are chosen again while a round links at least one in so many of the pairs that it compares.
WORTH = 4
#: Bytes of normalised text that are hashed at a time; shingles of the sets that a task remembers.
BATCH_BYTES, HELD_SHINGLES = 2_000_000, 100_000
#: The hashes of words depend on it.
_KEY = b"near duplicates"

_SEEDS = np.random.RandomState(20240229)
_MULTIPLY = (_SEEDS.randint(0, 2**32, MINIMA, dtype=np.uint64).astype(np.uint32)) | np.uint32(1)
_ADD = _SEEDS.randint(0, 2**32, MINIMA, dtype=np.uint64).astype(np.uint32)


def normalise(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return text.encode().lower().split() if text else []


def shingle_set(text: str | None, width: int) -> set[tuple[bytes, ...]]:
    """The distinct shingles of ``width`` words; a shorter text is one shingle, a text without words has none."""
    w = normalise(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return set(zip(*(w[i:] for i in range(width))))


def _hash64(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=8, key=_KEY).digest()


def shingle_hashes(texts: list[list[bytes]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """``texts``: their words, none empty. Sorted distinct 64-bit hashes of each text's shingles, one after another,
    and where each text's begin. Words have keyed hashes, which a shingle mixes one after another."""
    number: dict[bytes, int] = {}
    flat = np.array([number.setdefault(w, len(number)) for t in texts for w in t], np.int64)
    h = word = np.frombuffer(b"".join(map(_hash64, number)), "<u8")[flat]
    for k in range(1, width):
        h = mix(h[: len(word) - k] * U(BASE) + word[k:])
    out, at = [], 0
    for t in texts:
        short = len(t) < width
        out.append(np.frombuffer(_hash64(b" ".join(t) + b"\x00"), "<u8") if short else np.unique(h[at : at + len(t) - width + 1]))
        at += len(t)
    return mix(np.concatenate(out)), np.cumsum([0, *map(len, out)])[:-1]


def _signatures(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each set: the bands' buckets, the packed low bits of the minima."""
    x = (hashes >> U(32)).astype(np.uint32)
    minima = np.empty((MINIMA, len(offsets)), np.uint32)
    for i in range(MINIMA):
        minima[i] = np.minimum.reduceat(x * _MULTIPLY[i] + _ADD[i], offsets)
    bands = np.empty((len(offsets), BANDS), np.int64)
    for b in range(BANDS):
        h = np.full(len(offsets), b + 1, U)
        for r in range(BAND_ROWS):
            h = h * U(0x100000001B3) + minima[b * BAND_ROWS + r]
            h ^= h >> U(31)
        bands[:, b] = mix(h * U(BASE)).view(np.int64)
    low = ((minima ^ (minima >> np.uint32(16))) & np.uint32((1 << BITS) - 1)).astype(U)
    packed = np.zeros((len(offsets), LONGS), U)
    for i in range(MINIMA):
        at = i * BITS
        packed[:, at // 64] |= low[i] << U(at % 64)
    return bands, packed.view(np.int64)


def _batches(rows: list[tuple]) -> Iterator[list[tuple]]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(map(len, r[2])) + len(r[2])
        if size >= BATCH_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """``docs``: (doc_id, text_key, text). One row each: doc_id, text_key, n (size of the set), and, null for a text
    without words: cls (128 bits of the words' SHA-256), bands, packed."""
    schema = StructType([docs.schema["doc_id"], StructField("text_key", BinaryType()), StructField("n", LongType()), StructField("cls", BinaryType()), StructField("bands", ArrayType(LongType())), StructField("packed", ArrayType(LongType()))])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            id_type = b.schema.field(0).type
            rows = [(i, k, normalise(t)) for i, k, t in zip(*(b.column(j).to_pylist() for j in range(3)))]
            if none := [r for r in rows if not r[2]]:
                blank = lambda kind: pa.nulls(len(none), kind)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in none], id_type), pa.array([r[1] for r in none], pa.binary()), pa.array([0] * len(none), pa.int64()), blank(pa.binary()), blank(longs), blank(longs)], names=names)
            for part in _batches([r for r in rows if r[2]]):
                hashes, offsets = shingle_hashes([r[2] for r in part], width)
                bands, packed = _signatures(hashes, offsets)
                lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.ravel()))
                classes = [hashlib.sha256(b" ".join(r[2])).digest()[:16] for r in part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in part], id_type), pa.array([r[1] for r in part], pa.binary()), pa.array(np.diff(np.append(offsets, len(hashes)))), pa.array(classes, pa.binary()), lists(bands), lists(packed)],
                    names=names,
                )

    return map_in_arrow(docs.select("doc_id", "text_key", "text"), run, schema)


def _may_be_similar(a: str, b: str, percent: int) -> Column:
    """By size and by estimate: columns n and p0, p1, ... under the prefixes a and b."""
    low = 0x5555555555555555
    differ = sum(F.bit_count((x := F.col(f"{a}p{i}").bitwiseXOR(F.col(f"{b}p{i}"))).bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(low))) for i in range(LONGS))
    chance = 2.0**-BITS
    estimate = ((MINIMA - differ) / F.lit(float(MINIMA)) - chance) / (1 - chance)
    sizes = (100 * F.col(f"{a}n") >= percent * F.col(f"{b}n")) & (100 * F.col(f"{b}n") >= percent * F.col(f"{a}n"))
    return sizes & (estimate >= percent / 100 - MARGIN)


def _first_shared(a: str, b: str) -> Column:
    """The first bucket that two lists of buckets by band have in one place."""
    return F.get(F.filter(F.zip_with(a, b, lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull()), F.lit(0))


def _meet(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of two sides that no bound holds for: neither is broadcast, and Spark may split what is hot."""
    return left.join(right.hint("merge"), on, how)


def _row_key(doc_id: Column, text_key: Column, id_type: DataType) -> list[Column]:
    """Columns k0 to k2 that name a row by its id, which may be null, and its text."""
    return [doc_id.isNull().alias("k0"), F.coalesce(doc_id, F.lit("0").cast(id_type)).alias("k1"), text_key.alias("k2")]


class _Sets:
    """Shingle sets by text, the last ones remembered."""

    def __init__(self, width: int):
        self.width, self.held, self.size = width, {}, 0

    def of(self, text: str) -> set:
        if text not in self.held:
            found = shingle_set(text, self.width)
            if self.size + len(found) > HELD_SHINGLES:
                self.held, self.size = {}, 0
            self.held[text] = found
            self.size += len(found)
        return self.held[text]


def _with_texts(pairs: DataFrame, texts: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with the texts of the classes in columns a and b as ta and tb."""
    both = _meet(pairs, texts.select(F.col("cls").alias(a), F.col("text").alias("ta")), a)
    return _meet(both, texts.select(F.col("cls").alias(b), F.col("text").alias("tb")), b)


def _confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full shingle sets are similar enough."""
    both = _with_texts(pairs, texts, "a", "b").select("a", "b", "ta", "tb")
    schema = StructType([StructField("a", BinaryType()), StructField("b", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(width)
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                sa, sb = sets.of(ta), sets.of(tb)
                shared = len(sa & sb)
                keep.append(100 * shared >= percent * (len(sa) + len(sb) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_in_arrow(both, run, schema)


def _differences(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``pairs``: (cls, comp, hub). Adds n and hub_n (sizes of the sets) and diff (hashes of the shingles that only
    one of them has)."""
    both = _with_texts(pairs, texts, "cls", "hub").select("cls", "comp", "hub", "ta", "tb")
    schema = StructType([StructField(c, BinaryType()) for c in ("cls", "comp", "hub")] + [StructField("n", LongType()), StructField("hub_n", LongType()), StructField("diff", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(width)
        for batch in batches:
            n, hub_n, diff = [], [], []
            for ta, tb in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                sa, sb = sets.of(ta), sets.of(tb)
                n.append(len(sa))
                hub_n.append(len(sb))
                diff.append([int.from_bytes(_hash64(b" ".join(x)), "little", signed=True) for x in sa ^ sb])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(n, pa.int64()), pa.array(hub_n, pa.int64()), pa.array(diff, pa.list_(pa.int64()))], names=schema.fieldNames())

    return map_in_arrow(both, run, schema)


def _shared_elements(diffs: DataFrame, percent: int, held: Scratch) -> DataFrame:
    """(cls, comp, hub, n, d, over, least, e, often): the elements of differences that two classes of different
    components have, one of them not linked to the hub (``over`` > 0); of classes that have ``least`` elements or more
    which aren't theirs alone, as no class with fewer is similar to one of another component. At most a row per element."""
    p, q = 100 + percent, 100 - percent
    rows = diffs.select("cls", "comp", "hub", "n", "diff", F.size("diff").cast("long").alias("d"), (p * F.size("diff") - q * (F.col("n") + F.col("hub_n"))).alias("over"))
    # Whatever the other class is: an unlinked one shares at least over / 200, one it is linked with more than this.
    least = F.when(F.col("over") > 0, F.greatest(F.lit(1), F.ceil(F.col("over") / 200))).otherwise(F.floor(percent * F.col("d") / p) + 1)
    rows = rows.withColumn("least", least)
    found = rows.select("cls", "comp", "hub", (F.col("over") > 0).alias("out"), F.explode("diff").alias("e"))
    elements = found.groupBy("hub", "e").agg(F.count("*").alias("often"), F.min("cls").alias("cls"), ((F.min("comp") != F.max("comp")) & F.max("out")).alias("tells"))
    elements = held.table(elements.where((F.col("often") == 1) | F.col("tells")), "near-elements")
    # Of the elements that tell nothing only their number is needed: they come first in every list.
    alone = elements.where(F.col("often") == 1).groupBy("cls", "hub").agg(F.count("*").alias("alone"))
    rows = _meet(rows, alone, ["cls", "hub"], "left").where(F.col("d") - F.coalesce("alone", F.lit(0)) >= F.col("least"))
    each = rows.select("cls", "comp", "hub", "n", "d", "over", "least", F.explode("diff").alias("e"))
    return _meet(each, elements.where("tells").select("hub", "e", "often"), ["hub", "e"])


def _by_difference(diffs: DataFrame, percent: int, held: Scratch) -> DataFrame:
    """Pairs (a, b) of classes with one hub that may be similar though they aren't both linked to it.

    With sizes n and differences d, sets are similar if and only if the shared part o of their differences is at
    least ((d + d') - (n + n') (100 - percent) / (100 + percent)) / 2, which is more than 0 if one isn't linked to
    the hub. With the elements of each in one order, the first that they share has o - 1 more behind it in both; so
    its place is at most d - o. Rare elements come first."""
    p, q = 100 + percent, 100 - percent
    each = _shared_elements(diffs, percent, held)
    lists = each.groupBy("cls", "hub").agg(*[F.first(c).alias(c) for c in ("comp", "n", "d", "over", "least")], F.sort_array(F.collect_list(F.struct("often", "e"))).alias("es"))
    exploded = lists.select("cls", "comp", "hub", "n", "d", "over", "least", F.size("es").alias("m"), F.posexplode("es").alias("i", "x"))
    prefix = held.table(exploded.withColumn("at", (F.col("d") - F.col("m") + F.col("i")).cast("long")).where(F.col("at") + F.col("least") <= F.col("d")).select("cls", "comp", "hub", "n", "d", (F.col("over") > 0).alias("out"), F.col("x.e").alias("e"), "at"), "near-prefix")
    a, b = (prefix.select("hub", "e", *[F.col(c).alias(f"{s}_{c}") for c in ("cls", "comp", "n", "d", "out", "at")]) for s in "ab")
    shared = F.ceil((p * (F.col("a_d") + F.col("b_d")) - q * (F.col("a_n") + F.col("b_n"))) / (2 * p))
    fits = (F.col("a_at") + shared <= F.col("a_d")) & (F.col("b_at") + shared <= F.col("b_d"))
    sizes = (100 * F.col("a_n") >= percent * F.col("b_n")) & (100 * F.col("b_n") >= percent * F.col("a_n"))
    met = _meet(a, b, ["hub", "e"]).where((F.col("a_cls") < F.col("b_cls")) & (F.col("a_comp") != F.col("b_comp")) & (F.col("a_out") | F.col("b_out")) & sizes & fits)
    return met.select(F.col("a_cls").alias("a"), F.col("b_cls").alias("b")).distinct()


def _linked(diffs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of classes with their hubs."""
    return diffs.where((100 + percent) * F.size("diff") <= (100 - percent) * (F.col("n") + F.col("hub_n"))).select(F.col("cls").alias("a"), F.col("hub").alias("b"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key (SHA-256 of the text), n_shingles, component_id, kept, component
    (what its component's rows share; null for a text without words).

    Two texts are linked if their sets of ``width``-word shingles share ``percent`` percent of their union;
    component_id is the smallest doc_id that links reach, kept says that this is the row's own id. A text of
    fewer words is one shingle. A null or empty text, or one without words, is linked with nothing: its
    component is its own id. Ids may repeat or be null: a null id is never the smallest of a component that has
    others, and where all are null, component_id is null and the row is kept. All rows of the smallest id in
    a component are kept. Other columns are not looked at. An empty table gives no rows."""
    held = Scratch(docs.sparkSession)
    id_type = docs.schema[doc_id].dataType
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("text_key", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    signed = held.table(signatures(docs, width), "near-signed")
    grouped = signed.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("r"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("packed").alias("packed"))
    classes = held.table(grouped.select("cls", F.col("r.doc_id").alias("rep"), F.col("r.text_key").alias("text_key"), "n", "bands", "packed"), "near-classes")

    # Buckets with two classes or more, and the classes in them, each with one text.
    members = classes.select("cls", F.explode("bands").alias("bucket"))
    shared = held.table(members.groupBy("bucket").agg(F.count("*").alias("m")).where(F.col("m") > 1), "near-buckets")
    live = held.table(_meet(members, shared, "bucket"), "near-live")
    weight = held.table(live.groupBy("cls").agg(F.sum("m").alias("weight")), "near-weight")
    keys = _meet(classes.select("cls", "rep", "text_key"), weight, "cls").select("cls", *_row_key(F.col("rep"), F.col("text_key"), id_type))
    rows_of = docs.select(*_row_key(F.col("doc_id"), F.col("text_key"), id_type), "text")
    texts = held.table(_meet(rows_of, keys, ["k0", "k1", "k2"]).groupBy("cls").agg(F.min("text").alias("text")), "near-texts")
    facts = lambda p, *more: classes.select(F.col("cls").alias(p), F.col("n").alias(f"{p}n"), *[F.col("packed")[i].alias(f"{p}p{i}") for i in range(LONGS)], *more)

    # Each class against the weightiest hub of its buckets, then those left out against hubs of their own.
    comps, first_hubs, seats = None, None, live.select("bucket", "cls", F.col("cls").alias("comp"))
    while True:
        hubs = held.table(_meet(seats, weight, "cls").groupBy("bucket").agg(F.max(F.struct("weight", F.col("cls").alias("hub"), F.col("comp").alias("hub_comp"))).alias("h")), "near-hubs")
        first_hubs = first_hubs or hubs
        best = _meet(seats, hubs, "bucket").where(F.col("comp") != F.col("h.hub_comp")).groupBy("cls").agg(F.max("h")["hub"].alias("hub"))
        stars = best.select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")).distinct()
        likely = held.table(_meet(_meet(stars, facts("a"), "a"), facts("b"), "b").where(_may_be_similar("a", "b", percent)).select("a", "b"), "near-pairs")
        found = held.table(_confirm(likely, texts, width, percent), "near-links")
        more = found if comps is None else found.unionByName(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")))
        comps = components(more)
        labelled = held.table(_meet(live, comps.withColumnRenamed("node", "cls"), "cls", "left").select("bucket", "cls", "m", F.coalesce("comp", "cls").alias("comp")), "near-labelled")
        by_comp = labelled.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
        still = by_comp.groupBy("bucket").agg(F.count("*").alias("comps"), F.max(F.struct("k", "comp"))["comp"].alias("main")).where(F.col("comps") > 1).select("bucket", "main")
        rows = held.table(_meet(labelled, still, "bucket"), "near-rows")
        if found.count() * WORTH < likely.count() or found.isEmpty():
            break
        seats = rows.where(F.col("comp") != F.col("main")).select("bucket", "cls", "comp")
    # Small open buckets: classes outside the largest component against all. A pair is met in its first shared bucket.
    small = rows.where(F.col("m") <= SMALL)
    a = small.where(F.col("comp") != F.col("main")).select("bucket", F.col("cls").alias("a"), F.col("comp").alias("ca"))
    b = small.select("bucket", "main", F.col("cls").alias("b"), F.col("comp").alias("cb"))
    a, b = (held.table(_meet(x, facts(p, F.col("bands").alias(f"{p}s")), p), f"near-{p}") for x, p in ((a, "a"), (b, "b")))
    once = (F.col("cb") == F.col("main")) | (F.col("a") < F.col("b"))  # both outside: the pair comes twice
    rest = _meet(a, b, "bucket").where((F.col("ca") != F.col("cb")) & once & _may_be_similar("a", "b", percent) & (_first_shared("as", "bs") == F.col("bucket")))
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # Large open buckets: by what the classes differ in from a hub, one for all buckets whose hubs are one component.
    large, led = rows.where(F.col("m") > SMALL).select("bucket", "cls", "comp"), first_hubs.select("bucket", "h.weight", "h.hub")
    leading = _meet(large, led, "bucket").where(F.col("cls") == F.col("hub")).select("bucket", F.col("comp").alias("hub_comp"), "weight", "hub")
    chief = leading.groupBy("hub_comp").agg(F.max(F.struct("weight", "hub"))["hub"].alias("hub"))
    leading = held.table(_meet(leading.select("bucket", "hub_comp"), chief, "hub_comp").select("bucket", "hub"), "near-leading")
    against = _meet(large, leading, "bucket").where(F.col("cls") != F.col("hub")).select("cls", "comp", "hub").distinct()
    diffs = held.table(_differences(against, texts, width), "near-differences")
    rest = held.table(rest.unionByName(_by_difference(diffs, percent, held)).distinct(), "near-pairs")
    more = held.table(_confirm(rest, texts, width, percent).unionByName(_linked(diffs, percent)), "near-links")
    if not more.isEmpty():
        comps = components(more.unionByName(comps.select(F.col("node").alias("a"), F.col("comp").alias("b"))))

    ids = held.table(_meet(classes.select("cls", "rep"), comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "near-ids")
    smallest = held.table(ids.groupBy("comp").agg(F.min("rep").alias("component_id")), "near-smallest")
    of_class = held.table(_meet(ids, smallest, "comp").select("cls", "comp", "component_id"), "near-of-class")
    held.keep(signed, of_class)
    out = signed.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "cls")
    out = _meet(out, of_class, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.col("comp").alias("component"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with one row of each component: of those with the smallest id,
    not null if there is one, the one whose text has the smallest SHA-256. Rows without words all stay, but for
    repetitions of one id and text. Of rows that agree in id and text, the one whose other columns come first as
    JSON stays, so reruns agree."""
    held = Scratch(docs.sparkSession)
    found = held.table(near_duplicates(docs, width, percent).select("doc_id", "text_key", "component"), "near-found")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))
    chosen = found.where(F.col("component").isNotNull()).groupBy("component").agg(first.alias("c")).select("c.doc_id", "c.text_key")
    chosen = chosen.unionByName(found.where(F.col("component").isNull()).select("doc_id", "text_key")).distinct()
    keys = ["k0", "k1", "k2"]
    id_type = docs.schema["doc_id"].dataType
    chosen = held.table(chosen.select(*_row_key(F.col("doc_id"), F.col("text_key"), id_type)), "near-chosen")
    held.keep(chosen)
    whole = docs.select(F.struct(*docs.columns).alias("row"), *_row_key(F.col("doc_id"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), id_type))
    others = [F.col(f"row.{c}") for c in docs.columns if c not in ("doc_id", "text")]
    # No bound holds for the chosen rows, so they are never broadcast.
    return _meet(whole, chosen, keys, "left_semi").groupBy(*keys).agg(F.min_by("row", F.to_json(F.struct(*others)) if others else F.lit(0)).alias("row")).select("row.*")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``near_duplicates`` over all documents, four-word shingles; nulls, empty and repeated rows as described there."""
    rows = near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)
    return rows.select("doc_id", "n_shingles", "component_id", "kept")
