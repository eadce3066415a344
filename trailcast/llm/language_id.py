"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are made per task in numpy and summed by Spark; a log-probability matrix has a fixed number
of buckets and at most MAX_LANGUAGES languages, so its broadcast is bounded. More languages are
scored block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from trailcast.llm import common

#: Hash buckets of the n-grams.
BUCKETS = 1 << 16
#: Lengths of the character n-grams.
GRAMS = (1, 2, 3)
#: Languages of a block: with BUCKETS it bounds a broadcast matrix (32 MB). More languages are more blocks.
MAX_LANGUAGES = 128
#: Characters that are turned into n-grams at once.
CHUNK_CHARS = 1 << 18
#: Prediction for texts that are null or have no letter.
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    """Learned languages (or a block of them) and, per n-gram bucket, their log probabilities; log priors."""

    languages: list[str]
    log_prob: np.ndarray
    log_prior: np.ndarray


def in_fold(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text has this remainder; a null id has none."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts)) == part, F.lit(False))


def _buckets(points: np.ndarray) -> Iterator[np.ndarray]:
    """For each n-gram length the bucket of the n-gram that starts at each character."""
    points = points.astype(np.uint64)
    value = np.zeros(len(points), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        value = value * np.uint64(1_000_003)
        if n > 1:
            value[:1 - n] += points[n - 1:]
        else:
            value += points
        if n in GRAMS:
            yield (((value + np.uint64(n)) * _ODD) >> np.uint64(48)).astype(np.int64)


def _batches(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of texts with their code points (lower case, each text closed by two line ends) and starts."""
    at = 0
    while at < len(texts):
        end, size, part = at, 0, []
        while end < len(texts) and (size < CHUNK_CHARS or end == at):
            part.append((texts[end] or "").lower() + "\n\n")
            size += len(part[-1])
            end += 1
        starts = np.concatenate([[0], np.cumsum([len(p) for p in part])[:-1]]).astype(np.int64)
        yield at, end, np.frombuffer("".join(part).encode("utf-32-le"), np.uint32), starts
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    documents: dict[str, int] = {}
    for batch in batches:
        by_language: dict[str, list[str]] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by_language.setdefault(lang, []).append(text)
        for lang, texts in by_language.items():
            documents[lang] = documents.get(lang, 0) + len(texts)
            total = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for _, _, points, _ in _batches(texts):
                for bucket in _buckets(points):
                    total += np.bincount(bucket, minlength=BUCKETS)
    for lang, total in counts.items():
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * (len(used) + 1)), pa.array(np.append(used, -1)),
             pa.array(np.append(total[used], documents[lang]))], ["lang", "bucket", "n"])


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> list[Model]:
    """Learn from all rows whose text and language are not null: blocks of at most MAX_LANGUAGES languages by name.

    An empty table gives one block without languages, which predicts ``und`` for everything.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where(
        "text is not null and lang is not null")
    counts = common.write_table(rows.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n")))
    totals = counts.where("bucket = -1").select("lang", "n").toPandas().sort_values("lang")  # a row a language
    if not len(totals):
        return [Model([], np.zeros((0, BUCKETS)), np.zeros(0))]
    blocks = []
    for at in range(0, len(totals), MAX_LANGUAGES):
        own = totals.iloc[at:at + MAX_LANGUAGES]
        languages = own["lang"].tolist()
        table = counts.where((F.col("bucket") >= 0) & F.col("lang").between(languages[0], languages[-1])).toPandas()
        matrix = np.ones((len(languages), BUCKETS))  # one more of each bucket: Laplace smoothing
        column = {x: i for i, x in enumerate(languages)}
        np.add.at(matrix, (table["lang"].map(column).to_numpy(np.int64), table["bucket"].to_numpy(np.int64)),
                  table["n"].to_numpy(float))
        blocks.append(Model(languages, np.log(matrix / matrix.sum(axis=1, keepdims=True)),
                            np.log(own["n"].to_numpy(float) / float(totals["n"].sum()))))
    return blocks


def weigh(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the best language of a block (its number), its log score, and the log of all scores' sum."""
    best, top, whole = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts))
    for at, end, points, starts in _batches(texts):
        total = np.repeat(model.log_prior[:, None], end - at, axis=1)
        for bucket in _buckets(points):
            for k in range(len(model.languages)):
                total[k] += np.add.reduceat(model.log_prob[k][bucket], starts)
        best[at:end] = total.argmax(axis=0)
        top[at:end] = total.max(axis=0)
        with np.errstate(under="ignore"):
            whole[at:end] = top[at:end] + np.log(np.exp(total - top[at:end]).sum(axis=0))
    return best, top, whole


def _with_letters(texts: list[str | None]) -> np.ndarray:
    return np.array([bool(t) and _LETTER.search(t) is not None for t in texts], bool)


def identify(docs: DataFrame, model: list[Model], text: str = "text") -> DataFrame:
    """Add lang_pred and score (posterior probability, 0 for ``und``) to every row.

    Null texts and texts without a letter (empty ones too) get ``und``; of languages with equal
    scores the smallest name wins; repeated rows are scored alike. Input columns called lang_pred
    or score are replaced. Narrow passes without a shuffle, one for each block of languages.
    """
    docs = docs.drop("lang_pred", "score", "_top", "_whole")
    spark, at = docs.sparkSession, docs.columns.index(text)
    said = docs.select("*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(float("-inf")).alias("_top"), F.lit(float("-inf")).alias("_whole"))
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("_top", DoubleType()),
                         StructField("_whole", DoubleType())])

    def scored_by(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for batch in batches:
                names, top, whole = (batch.column(batch.num_columns - i) for i in (3, 2, 1))
                top, whole = top.to_numpy(zero_copy_only=False).copy(), whole.to_numpy(zero_copy_only=False)
                texts = batch.column(at).to_pylist()
                if model.languages and len(texts):
                    best, here, block = weigh(model, texts)
                    known = _with_letters(texts)
                    better = known & (here > top)
                    names = pa.array(np.where(better, np.array(model.languages, object)[best], names.to_numpy(zero_copy_only=False)), pa.string())
                    top = np.where(better, here, top)
                    whole = np.where(known, np.logaddexp(whole, block), whole)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-3], names, pa.array(top), pa.array(whole)], batch.schema.names)

        return run

    for block in model:
        said = said.mapInArrow(scored_by(spark.sparkContext.broadcast(block)), schema)
    certain = F.when(F.col("lang_pred") == UNKNOWN, 0.0).otherwise(F.least(F.lit(1.0), F.exp(F.col("_top") - F.col("_whole"))))
    return said.select(*docs.columns, "lang_pred", certain.alias("score"))


def held_out_predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows that are not held out."""
    held = in_fold(F.col("doc_id"), 4, 2)
    model = fit(docs.where(~held))
    said = identify(docs.select("doc_id", held.cast(BooleanType()).alias("held_out"), "text"), model)
    return said.select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows with a predicted language, however unsure, by the model fitted on the labelled rows."""
    model = fit(docs)
    said = identify(docs.withColumn("_in_text", F.col("text")).select(F.struct(*docs.columns).alias("_in"), "_in_text"),
                    model, "_in_text")
    return said.where(F.col("lang_pred") != UNKNOWN).select("_in.*")
