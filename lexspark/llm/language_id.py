"""Language identification by compression.

Every language gets a zstandard raw-content dictionary made of a bounded sample of its labelled texts. A text is
compressed with each dictionary; the language whose dictionary makes it smallest is predicted, and the prediction
is rejected if the runner-up is nearly as small.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

from lexspark.llm.common import crc_bucket, map_in_arrow, table, with_fields

#: Bytes of a dictionary, texts sampled for one language, and characters of a piece of one.
DICT_BYTES, SAMPLE_TEXTS, PIECE_CHARS = 65_536, 96, 1_024
#: The dictionaries travel to every task, so their number has a bound.
MAX_LANGUAGES = 256
#: Groups in which the texts of a language are ranked first.
RANK_GROUPS = 32
#: Texts are compressed in pieces of so many bytes, so that margins don't depend on a text's length.
PIECE_BYTES = 8_192
#: A prediction is rejected if the second smallest is larger by less than this share.
MIN_MARGIN = 0.01
#: Predicted where there is nothing to go by.
UNDETERMINED = "und"

_NO_WORD = bytes(b for b in range(128) if not (chr(b).isalpha() or b in b" \t\n\v\f\r"))


def _letters(text: str) -> bytes:
    """Lower-cased UTF-8 without ASCII digits and punctuation; runs of ASCII white space become one space."""
    return b" ".join(text.lower().encode().translate(None, _NO_WORD).split())


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def fit_dictionaries(train: DataFrame, text: str = "text", lang: str = "lang", sample_texts: int = SAMPLE_TEXTS, piece_chars: int = PIECE_CHARS, max_languages: int = MAX_LANGUAGES) -> dict[str, bytes]:
    """A dictionary for every language in ``train``; rows with a null text or label don't count.

    The sample of a language is bounded by ``sample_texts``: the distinct texts with the smallest hash, of any
    length, and of each the ``piece_chars`` characters that begin where its hash says. So the driver gets at most
    ``max_languages * sample_texts * piece_chars`` characters; more languages raise a ValueError. The same rows are
    chosen at every run, and a text that occurs often counts once. Only the hashes are ranked, first in groups of a
    language and then the best of these; the texts behind the chosen ones are fetched after that. An empty table
    gives no dictionary."""
    rows = train.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    chosen = rows.select("lang", "h").distinct().withColumn("group", F.pmod("h", F.lit(RANK_GROUPS)))
    for keys in (["lang", "group"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("h"))
        chosen = chosen.withColumn("rank", rank).where(F.col("rank") <= sample_texts)
    chosen = chosen.select("lang", "h", "rank")
    n = rows.select("lang").distinct().count()
    if n > max_languages:
        raise ValueError(f"{n} languages; their dictionaries are sent to every task, so there may be {max_languages}")
    begin = F.pmod(F.col("h"), F.greatest(F.lit(1), F.length("text") - piece_chars + 1)) + 1
    piece = F.substring(F.col("text"), begin.cast("int"), F.lit(piece_chars))
    texts = rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "rank").agg(F.min(piece).alias("text"))
    out: dict[str, bytes] = {}
    for r in sorted(texts.collect(), key=lambda r: (r["lang"], -r["rank"])):
        out[r["lang"]] = (out.get(r["lang"], b"") + b" " + _letters(r["text"]))[-DICT_BYTES:]
    return out


class _Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        # Small tables and a greedy-lazy parse: setting up costs little, and matches of four bytes count.
        params = zstandard.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=16, search_log=4, min_match=4, target_length=16, strategy=zstandard.STRATEGY_LAZY, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.by_lang = {}
        for lang in sorted(dictionaries):
            d = zstandard.ZstdCompressionDict(dictionaries[lang].ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.by_lang[lang] = zstandard.ZstdCompressor(dict_data=d, compression_params=params)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and the margin: by what share the runner-up is larger."""
        if not self.by_lang or not _has_letter(text):
            return UNDETERMINED, 0.0
        data = _letters(text)
        pieces = [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)] or [data]
        sizes = sorted((sum(len(c.compress(p)) for p in pieces), lang) for lang, c in self.by_lang.items())
        if len(sizes) == 1:
            return sizes[0][1], 1.0
        return sizes[0][1], (sizes[1][0] - sizes[0][0]) / sizes[1][0]


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """Adds lang_pred, score (the margin, 0 to 1) and accepted to every row; columns of these names are replaced.

    A null text, an empty one and one without a letter get ``und``, 0 and false. Of languages with equal sizes
    the first by name is predicted, with margin 0, and rejected. Equal texts get equal predictions."""
    spark = docs.sparkSession
    docs = docs.drop("lang_pred", "score", "accepted")
    held = spark.sparkContext.broadcast(dictionaries)  # at most MAX_LANGUAGES of DICT_BYTES each
    schema = with_fields(docs, lang_pred=StringType(), score=DoubleType(), accepted=BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _Classifier(held.value)
        for b in batches:
            found = [model.predict(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            langs, scores = [f[0] for f in found], [f[1] for f in found]
            accepted = [lang != UNDETERMINED and s >= min_margin for lang, s in found]
            columns = [*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, "lang_pred", "score", "accepted"])

    return map_in_arrow(docs, run, schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by dictionaries of those not held out; nulls and empty texts as in ``identify``."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc_bucket(F.col("doc_id"), 3) == 1
    dictionaries = fit_dictionaries(docs.where(~held_out).select("text", "lang"))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), dictionaries).select("doc_id", "held_out", "lang_pred", "score", "accepted")
