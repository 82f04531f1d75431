"""Language of a text from a bidirectional gated recurrent network over its bytes.

Each position of the text gets a probability of each language; a text's
probability is their mean over all positions. The network is trained in numpy on
the driver, on a bounded sample that is the same at every size of the input:
`SAMPLE_ROWS` rows of each language, first by a hash of their id, and
`SAMPLE_SEGMENTS` segments of `SEGMENT` bytes of each. Every byte of every row is
then labelled, in segments, by the tasks that read it.

A null text, or one without a letter, is `und` with score 0. Without a row to
learn from, all are. Rows that share a doc_id are labelled one by one; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hackney.llm.common import slices, text_of
from hackney.llm.gru import PAD, Network

SEGMENT = 64
HIDDEN = 6
SAMPLE_ROWS = 300
SAMPLE_SEGMENTS = 6
#: Segments that advance together.
BATCH = 4096
UNKNOWN = "und"


def held_out() -> Column:
    """Rows that learning must not see."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def _segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts cut into rows of SEGMENT bytes, and the text that each row is of."""
    lengths = np.diff(offsets)
    counts = -(-lengths // SEGMENT)
    owner = np.repeat(np.arange(len(lengths)), counts)
    first = np.cumsum(counts) - counts
    out = np.full(int(counts.sum()) * SEGMENT, PAD, np.uint8)
    shift = np.repeat(first * SEGMENT - offsets[:-1], lengths)
    out[np.arange(len(data)) + shift] = data
    return out.reshape(-1, SEGMENT), owner


def train(docs: DataFrame) -> tuple[Network | None, list[str]]:
    """A network and its languages, from the rows that are not held out."""
    usable = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), text_of().alias("text")).filter(
        F.col("lang").isNotNull() & ~held_out() & F.col("text").rlike(r"\p{L}")
    )
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    # Only ids are ranked, and Spark keeps the first of each language in every task before it groups them.
    picked = (
        usable.select("doc_id", "lang", F.xxhash64("text").alias("tie"), F.row_number().over(order).alias("place"))
        .filter(F.col("place") <= SAMPLE_ROWS)
        .select("doc_id", "lang", "tie")
        .distinct()
    )
    here = usable.withColumn("tie", F.xxhash64("text"))
    same = [here[name].eqNullSafe(picked[name]) for name in ("doc_id", "lang", "tie")]
    piece = F.expr(
        f"transform(sequence(0, {SAMPLE_SEGMENTS - 1}), i -> substring(encode(text, 'utf-8'), "
        f"cast(pmod(xxhash64(doc_id, i), greatest(octet_length(text) - {SEGMENT}, 0) + 1) as int) + 1, {SEGMENT}))"
    )
    rows = (
        here.join(F.broadcast(picked), same, "left_semi")
        .dropDuplicates(["doc_id", "lang", "tie"])
        .select("doc_id", "lang", "tie", piece.alias("pieces"))
        .orderBy("lang", "doc_id", "tie")
        .collect()
    )
    langs = sorted({row["lang"] for row in rows})
    if not langs:
        return None, []
    segments = np.full((len(rows) * SAMPLE_SEGMENTS, SEGMENT), PAD, np.uint8)
    classes = np.repeat([langs.index(row["lang"]) for row in rows], SAMPLE_SEGMENTS)
    for i, piece_ in enumerate(piece_ for row in rows for piece_ in row["pieces"]):
        segments[i, : len(piece_)] = np.frombuffer(bytes(piece_), np.uint8)
    network = Network(len(langs), HIDDEN)
    network.train(segments, classes, rounds=max(6, 6 * 6000 // len(segments)) if len(segments) < 6000 else 6, batch=256, rate=0.02)
    return network, langs


def pooled(network: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean probability of each class over the bytes of each text."""
    rows, owner = _segments(data, offsets)
    classes = len(network.top["bias"])
    sums = np.zeros((len(offsets) - 1, classes))
    for start in range(0, len(rows), BATCH):
        letters = np.ascontiguousarray(rows[start : start + BATCH].T)
        found = network.probabilities(letters)
        found *= (letters != PAD)[:, :, None]
        by_row, own = found.sum(0), owner[start : start + BATCH]
        for label in range(classes):
            sums[:, label] += np.bincount(own, by_row[:, label], len(sums))
    return sums / np.maximum(sums.sum(1, keepdims=True), 1e-12)


def languages(docs: DataFrame, network: Network | None, langs: list[str]) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    text = text_of()
    rows = docs.select("doc_id", held_out().alias("held_out"), text.alias("text"), text.rlike(r"\p{L}").alias("written"))
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            written = batch.column("written").to_numpy(zero_copy_only=False).astype(bool)
            names, best = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            if langs:
                found = pooled(shared.value, data, offsets)
                names[written] = np.array(langs, object)[found.argmax(1)][written]
                best[written] = np.clip(found.max(1), 0, 1)[written]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(best, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
