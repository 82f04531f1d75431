"""Quality scores from how well a text compresses with dictionaries of good and of bad text.

Two zstandard dictionaries are built, one from pieces of text labelled good and
one from pieces labelled bad. A text is cut into pieces of `PIECE` bytes, so that
the dictionary counts as much at the end of a long text as at its start, and
every piece is compressed with both. From the summed sizes come three numbers:
their difference over their sum, the logarithm of the compressed share, and the
logarithm of the length. A logistic regression on labelled texts that the
dictionaries have not seen turns them into the probability of a good text.

Learning takes a bounded sample of the labelled rows, the same at every size of
the input: `SAMPLE_ROWS` rows of each label, first by a hash of their id, and
`SAMPLE_PIECES` pieces of each. Every row and the whole of its text is scored.

A null text is empty and gets the score of an empty text. Label rows without an
id or with another label than 0 and 1 are passed over; an id labelled twice
counts as bad if one of its labels is 0. Without labelled rows of both kinds the
score is the share of good labels, or 0.5 without any. An empty table gives an
empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hackney.llm.common import CHUNK_BYTES, free_name, slices, text_of

PIECE = 2048
SAMPLE_ROWS = 4000
SAMPLE_PIECES = 6000
DICTIONARY_BYTES = 112_640
LEVEL = 3
KEEP_FROM = 0.3
RIDGE = 0.01


def held_out() -> Column:
    """Rows that learning must not see."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def _dictionary(pieces: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from: take it as it is
        return b"".join(pieces)[-DICTIONARY_BYTES:]


def _build(table: pa.Table) -> pa.Table:
    """The dictionary of one label's pieces."""
    table = table.sort_by([("order", "ascending"), ("piece", "ascending")])
    made = _dictionary([piece.encode("utf-8") for piece in table.column("piece").to_pylist()])
    return pa.table([table.column("label").slice(0, 1), pa.array([made], pa.binary())], names=["label", "dictionary"])


@functools.lru_cache(maxsize=4)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_AUTO
    loaded = zstandard.ZstdCompressionDict(dictionary, dict_type=kind)
    loaded.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=loaded, write_content_size=False, write_dict_id=False)


def sizes(text: memoryview, dictionaries: tuple[bytes, bytes]) -> tuple[int, int, int]:
    """Compressed with the bad and with the good dictionary, and plain."""
    bad, good = map(_compressor, dictionaries)
    pieces = [text[start : start + PIECE] for start in range(0, max(1, len(text)), PIECE)]
    return sum(len(bad.compress(piece)) for piece in pieces), sum(len(good.compress(piece)) for piece in pieces), len(text)


def _design(measured: np.ndarray) -> np.ndarray:
    bad, good, plain = measured.T.astype(float)
    difference = 20 * (bad - good) / (bad + good)
    share, length = np.log((good + 8) / (plain + 8)), np.log(plain + 1) / 8
    ones = np.ones(len(measured))
    return np.stack([ones, difference, share, share**2, share * difference, length, length**2, length * difference], 1)


def _logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a ridge on scaled columns; Newton's steps, halved until the loss falls."""
    middle, spread = x[:, 1:].mean(0), x[:, 1:].std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x[:, 1:] - middle) / spread])
    ridge = np.full(z.shape[1], RIDGE)
    ridge[0] = 1e-6

    def loss(beta: np.ndarray) -> float:
        margin = z @ beta * (2 * y - 1)
        return float((weights * np.logaddexp(0, -margin)).sum() + (ridge * beta * beta).sum() / 2)

    beta = np.zeros(z.shape[1])
    now = loss(beta)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        slope = z.T @ (weights * (y - p)) - ridge * beta
        curve = (z * (weights * p * (1 - p))[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        while loss(beta + step) > now and np.abs(step).max() > 1e-9:
            step /= 2
        after = loss(beta + step)
        beta += step if after <= now else 0
        if now - after < 1e-9 * max(1.0, now):
            break
        now = after
    scaled = beta[1:] / spread
    return np.concatenate([[beta[0] - scaled @ middle], scaled])


class Model:
    """Scores texts; plain data, so that tasks get it with their code."""

    def __init__(self, dictionaries: tuple[bytes, bytes], beta: np.ndarray):
        self.dictionaries, self.beta = dictionaries, beta

    def score(self, texts: list[memoryview]) -> np.ndarray:
        if not self.dictionaries[0]:
            return np.full(len(texts), float(self.beta[0]))
        measured = np.array([sizes(text, self.dictionaries) for text in texts]).reshape(-1, 3)
        return 1 / (1 + np.exp(-np.clip(_design(measured) @ self.beta, -30, 30)))


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """Texts of a bounded number of labelled rows, and how many rows have each label."""
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("label"))
    )
    known = known.filter(~held_out())
    counts = {row["label"]: row["n"] for row in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = [known.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS) for label in (0, 1)]
    # At most 2 * SAMPLE_ROWS pairs of numbers, so the broadcast is bounded.
    picked = F.broadcast(first[0].unionByName(first[1]))
    texts = docs.select("doc_id", text_of().alias("text")).join(picked, "doc_id")
    return texts.withColumn("fit", F.xxhash64("doc_id", F.lit(1)) % 2 == 0), counts


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from the labelled rows that are not held out."""
    sample, counts = _sample(docs, labels)
    total = sum(counts.values())
    if len(counts) < 2:
        return Model((b"", b""), np.array([counts.get(1, 0) / total if total else 0.5]))
    sample = sample.persist()
    pieces = (
        sample.filter("not fit")
        .select("doc_id", "label", F.expr(f"explode(sequence(0, greatest(length(text) - 1, 0) div {PIECE}))").alias("at"), "text")
        .select("label", F.xxhash64("doc_id", "at").alias("order"), F.expr(f"substring(text, at * {PIECE} + 1, {PIECE})").alias("piece"))
        .filter("piece != ''")
    )
    # At most SAMPLE_PIECES pieces of each label; the dictionaries are built in tasks, not on the driver.
    picked = [pieces.filter(F.col("label") == label).orderBy("order", "piece").limit(SAMPLE_PIECES) for label in (0, 1)]
    built = picked[0].unionByName(picked[1]).groupBy("label").applyInArrow(_build, "label int, dictionary binary").collect()
    found = {row["label"]: bytes(row["dictionary"]) for row in built}
    dictionaries = [found.get(0, b""), found.get(1, b"")]
    if not all(dictionaries):
        sample.unpersist()
        return Model((b"", b""), np.array([counts[1] / total]))
    measured = measure(sample.filter("fit"), (dictionaries[0], dictionaries[1])).select("label", "sizes").collect()
    sample.unpersist()
    y = np.array([row["label"] for row in measured], float)
    x = _design(np.array([row["sizes"] for row in measured], float).reshape(-1, 3))
    # Rows of each label weigh as much as all labelled rows have it, however many were sampled.
    share = np.where(y == 1, counts[1] / max(1, (y == 1).sum()), counts[0] / max(1, (y == 0).sum()))
    weights = share * len(y) / total
    return Model((dictionaries[0], dictionaries[1]), _logistic(x, y, weights))


def _views(text: pa.Array) -> Iterator[memoryview]:
    for value in text:
        yield memoryview(value.as_buffer())


def measure(rows: DataFrame, dictionaries: tuple[bytes, bytes]) -> DataFrame:
    """label and sizes of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(sizes(view, dictionaries)) for view in _views(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(found, pa.list_(pa.int64()))], names=["label", "sizes"]
            )

    return rows.select("label", "text").mapInArrow(run, "label int, sizes array<long>")


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    rows = docs.select("doc_id", held_out().alias("held_out"), text_of().alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in slices(batches, CHUNK_BYTES):
            found = shared.value.score(list(_views(batch.column("text"))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.float64())],
                names=["doc_id", "held_out", "score"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= KEEP_FROM).cast("int"))


def without_poor(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that are not predicted poor, with all their columns; each row is judged by its own text."""
    name = free_name(docs, "quality_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text):
        return _as_series(shared.value.score([memoryview(value.encode("utf-8")) for value in text]))

    return docs.withColumn(name, score(text_of())).filter(F.col(name) >= KEEP_FROM).drop(name)


def _as_series(values: np.ndarray):
    import pandas as pd

    return pd.Series(values)
