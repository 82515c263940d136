"""Operator 4: language identification by compression.

Texts are reduced to their letters, lower-cased, with single spaces between runs. For each language a raw-content zstandard dictionary is made of at most `dict_bytes` bytes of labelled texts (a
bounded sample of whole rows: the `SAMPLE_ROWS` of lowest text hash per language). A text is compressed in blocks
of `BLOCK` bytes with each dictionary, so every part of a long text is seen with the dictionary in reach, and the
language with the fewest bytes wins. score is 1 - 2^(-2 * bytes saved over the runner-up); a text is rejected
where that saving is under `MARGIN` of the runner-up's size, ties always.

Null text or text without a letter: und, score 0, rejected. Ties: the first language in code-point order, and rejected. Repeated rows: each has its row. No labelled row: every text is und. lang, source and
id are not looked at in predictions. Other columns are ignored. Very long texts: compressed whole. Empty table: no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanecast.llm.common import documents, texts_of

DICT_BYTES = 110_000
SAMPLE_ROWS = 200
BLOCK = 2048
MARGIN = 0.001
# zstandard's search, for text of a few kB against a dictionary: matches from three bytes on
SEARCH = {"window_log": 17, "chain_log": 16, "hash_log": 16, "search_log": 3, "min_match": 3, "target_length": 16}
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def letters(text: str) -> bytes:
    return " ".join(_LETTERS.findall(text.lower())).encode("utf-8")


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def fit(labelled: DataFrame, dict_bytes: int = DICT_BYTES, sample_rows: int = SAMPLE_ROWS) -> dict[str, bytes]:
    """A dictionary a language from lang, text. Per language the `sample_rows` texts of lowest hash: first those
    below a hash bound that about four times as many different texts pass, so that only few rows are ranked."""
    rows = labelled.where("lang IS NOT NULL AND length(text) > 0")
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n"))
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / (1 << 40)
    few = rows.join(F.broadcast(sizes), "lang").withColumn("place", place).where(F.col("place") * F.col("n") < 4 * sample_rows)  # sizes: a row a language
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("place", "text"))
    few = few.dropDuplicates(["lang", "text"]).withColumn("nth", nth).where(F.col("nth") <= sample_rows)
    texts: dict[str, list[bytes]] = {}
    have: dict[str, int] = {}
    for r in few.select("lang", "nth", F.substring("text", 1, dict_bytes).alias("text")).orderBy("lang", "nth").toLocalIterator():
        if have.get(r["lang"], 0) < dict_bytes:
            data = letters(r["text"])
            texts.setdefault(r["lang"], []).append(data)
            have[r["lang"]] = have.get(r["lang"], 0) + len(data)
    return {lang: b"\n".join(t)[:dict_bytes] for lang, t in sorted(texts.items())}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], block: int = BLOCK):
        import zstandard

        search = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0, **SEARCH)
        self.langs, self.block = sorted(dictionaries), block
        self.encoders = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=search)
            self.encoders.append(zstandard.ZstdCompressor(dict_data=d, compression_params=search))
        self.empty = [len(e.compress(b"")) for e in self.encoders]

    def sizes(self, text: str) -> list[int]:
        data = letters(text)
        blocks = [data[k : k + self.block] for k in range(0, len(data), self.block)]
        return [sum(len(e.compress(b)) - z for b in blocks) for e, z in zip(self.encoders, self.empty, strict=True)]

    def predict(self, text: str) -> tuple[str, float, float]:
        """Language, score and margin (share of the runner-up's size)."""
        if not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0
        ranked = sorted((n, lang) for n, lang in zip(self.sizes(text), self.langs, strict=True))
        if len(ranked) == 1:
            return ranked[0][1], 1.0, 1.0
        saved = ranked[1][0] - ranked[0][0]
        return ranked[0][1], 1.0 - 2.0 ** (-saved * 2), saved / max(1, ranked[1][0])


def identify(df: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected. The dictionaries, dict_bytes a language, are broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(dictionaries)

    def predict(batches):
        model = Classifier(shared.value)
        for batch, texts in texts_of(batches):
            out = [model.predict(t) for t in texts]
            columns = list(zip(*out, strict=True)) or [()] * 3
            lost = [lang == UNKNOWN or m <= 0 or m < margin for lang, _, m in out]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.float64()), pa.array(lost, pa.bool_())], ["doc_id", "lang_pred", "score", "margin", "rejected"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double, margin double, rejected boolean")


def keep_identified(df: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """The rows of df that are not rejected, with all their columns; decided in the same pass, row by row."""
    shared = df.sparkSession.sparkContext.broadcast(dictionaries)

    def keep(batches):
        model = Classifier(shared.value)
        for batch, texts in texts_of(batches):
            out = [model.predict(t) for t in texts]
            yield batch.filter(pa.array([lang != UNKNOWN and m > 0 and m >= margin for lang, _, m in out], pa.bool_()))

    return df.mapInArrow(keep, df.schema)


def op4_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("lang", "text"))
    return identify(docs, model).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")


QUERIES = {"op4_language_id": op4_language_id}
SQL: dict[str, str] = {}
