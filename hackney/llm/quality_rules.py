"""Rules that reject documents: counts of words and lines, and bands of perplexity.

Perplexity is that of a modified Kneser-Ney model (`kneser_ney`) in which every
character is a symbol of its own. With that many symbols a text would vouch for
itself, so the texts are dealt into two halves by their hash, equal texts into the
same one, and each half is judged by the model of the whole other half. Every task
counts its runs of symbols and Spark adds the counts up. A model of `BROADCAST_RUNS`
at most is broadcast. A larger one stays in tables (`kneser_ney_tables`); its frequent runs are
broadcast, and the others that texts hold are joined with it.

Bands are a language's own if it has one in `LANGUAGES` documents at least, which
bounds their number; documents of other languages, and those without one, share
the band of all documents. A band reaches `WIDTH` times as far from the middle document
as the farther of two quantiles does, in logarithms. Quantiles are read off
counts per language and hundredth, over all documents that pass the counts.

Null and empty texts have no words and fail the counts. Rows that share a doc_id
are judged one by one. Texts of any length count whole. A null language is a language unknown. An
empty table gives an empty result. Only doc_id, text and lang are read, so other
columns of any name do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hackney.llm import kneser_ney, kneser_ney_tables
from hackney.llm.common import checkpointed, slices, text_of, texts

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
#: A language has a band of its own if one in so many documents is of it.
LANGUAGES = 1000
#: Share of documents below the lower and above the upper quantile, and how many times as far a band reaches.
TAIL = 0.05
WIDTH = 4.0
#: Runs of 16 bytes that are broadcast at most, and that a task counts before it hands them on.
BROADCAST_RUNS = 1 << 22
COUNTED_RUNS = 1 << 22
#: Characters from which on words are numbered without a list of them.
LONG = 1 << 22

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
# The characters that count as symbols.
_SYMBOLS = "#*$%&|<>"
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _numbered(text: str) -> tuple[np.ndarray, int]:
    """A number for every word, equal for equal words, and the characters of all."""
    if len(text) < LONG:
        words = _WORD.findall(text)
        number = {word: place for place, word in enumerate(dict.fromkeys(words))}
        return np.fromiter(map(number.__getitem__, words), np.int64, len(words)), sum(map(len, words))
    number, letters = {}, 0

    def numbers() -> Iterator[int]:
        nonlocal letters
        for found in _WORD.finditer(text):
            letters += found.end() - found.start()
            yield number.setdefault(found[0], len(number))

    return np.fromiter(numbers(), np.int64), letters


def repeated_words(ids: np.ndarray) -> int:
    """Words in windows of three that occur twice or more."""
    if len(ids) < 4:
        return 0
    many = int(ids.max()) + 1
    pairs = ids[:-1] * many + ids[1:]
    if many >= 1 << 21:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * many + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    repeated = np.zeros(len(ids) + 2, bool)  # by the window's last word
    repeated[order[1:][same] + 2] = True
    repeated[order[:-1][same] + 2] = True
    return int((repeated[:-2] | repeated[1:-1] | repeated[2:]).sum())


def _lines_again(text: str) -> int:
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    return len(lines) - len(set(lines))


def counts_of(text: str) -> tuple[int, ...]:
    """The numbers of `_COUNTS`."""
    ids, letters = _numbered(text)
    return len(ids), letters, sum(map(text.count, _SYMBOLS)), _lines_again(text), repeated_words(ids)


def _count_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = kneser_ney.Tally()

    def counted() -> pa.RecordBatch:
        codes, counts = tally.merged()
        return pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(counts, pa.int64())], names=["code", "n"])

    for part, _, _ in slices(batches):
        for codes, _ in kneser_ney.hashes(part.column("text").to_pylist()):
            tally.add(codes)
            if tally.size() > COUNTED_RUNS:
                yield counted()
                tally = kneser_ney.Tally()
    yield counted()


def train(docs: DataFrame) -> kneser_ney.Model | kneser_ney_tables.Tables:
    """The model of all texts. At most `BROADCAST_RUNS` counts or probabilities reach the driver."""
    counted = texts(docs).select("text").mapInArrow(_count_runs, "code long, n long")
    counted = checkpointed(counted.groupBy("code").agg(F.sum("n").alias("n")))
    if counted.count() > BROADCAST_RUNS:
        return kneser_ney_tables.build(counted, BROADCAST_RUNS)
    found = counted.toArrow()
    codes, counts = found.column("code").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(codes)
    return kneser_ney.build(codes[order], counts[order])


def _runs_by_row(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """The rows, and for each its different codes and how many times it has them."""
    order = np.lexsort((codes, rows))
    codes, rows = codes[order], rows[order]
    first = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (rows[1:] != rows[:-1])))
    times = np.diff(np.append(first, len(codes)))
    codes, rows = codes[first], rows[first]
    begins = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    offsets = pa.array(np.append(begins, len(rows)), pa.int32())
    lists = (pa.ListArray.from_arrays(offsets, pa.array(values.view(np.int64))) for values in (codes, times))
    return rows[begins], *lists


def measures(docs: DataFrame, model: kneser_ney.Model | kneser_ney_tables.Tables) -> DataFrame:
    """doc_id, lang, the counts and log_perplexity (per symbol; null without text) of every document."""
    in_tables = isinstance(model, kneser_ney_tables.Tables)
    sent = docs.sparkSession.sparkContext.broadcast(model.frequent if in_tables else model)
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), text_of().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    fields = ", ".join(f"{name} long" for name in _COUNTS)
    schema = f"row long, doc_id {kind}, lang string, {fields}, letters long, log_sum double, codes array<long>, times array<long>"
    names = ["row", "doc_id", "lang", *_COUNTS, "letters", "log_sum", "codes", "times"]

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per document; from tables, more with the runs of a document that are not broadcast, and no counts."""
        list_type = pa.list_(pa.int64())
        next_row = TaskContext.get().partitionId() << 33
        for part, _, _ in slices(batches):
            given = part.column("text").to_pylist()
            sums, letters = np.zeros(len(given)), np.zeros(len(given), np.int64)
            for codes, owner in kneser_ney.hashes(given):
                letters += np.bincount(owner, minlength=len(given))
                if not in_tables:
                    sums += np.bincount(owner, sent.value.log_probabilities(codes), len(given))
                    continue
                found, known = sent.value.find(codes)
                sums += np.bincount(owner, found, len(given))
                if not known.all():
                    held, *lists = _runs_by_row(codes[~known], owner[~known] + next_row)
                    none = [pa.nulls(len(held), part.column(name).type) for name in ("doc_id", "lang")]
                    none += [pa.nulls(len(held), pa.int64())] * (len(_COUNTS) + 1) + [pa.nulls(len(held), pa.float64())]
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), *none, *lists], names=names)
            found = zip(*map(counts_of, given), strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(next_row, next_row + len(given))),
                    part.column("doc_id"),
                    part.column("lang"),
                    *(pa.array(x, pa.int64()) for x in found),
                    pa.array(letters),
                    pa.array(sums),
                    *[pa.nulls(len(given), list_type)] * 2,
                ],
                names=names,
            )
            next_row += len(given)

    measured = rows.mapInArrow(measure, schema)
    if in_tables:
        measured = checkpointed(measured)
        rest = measured.filter(F.col("codes").isNotNull()).select("row", F.explode(F.arrays_zip("codes", "times")).alias("run"))
        rest = rest.select("row", F.col("run.codes").alias("code"), F.col("run.times").alias("times"))
        joined = kneser_ney_tables.sums(rest, model.levels).withColumnRenamed("log_sum", "joined")
        measured = measured.filter(F.col("n_words").isNotNull()).join(joined, "row", "left")
        measured = measured.withColumn("log_sum", F.col("log_sum") + F.coalesce("joined", F.lit(0.0)))
    log_perplexity = F.when(F.col("letters") > 0, -F.col("log_sum") / F.col("letters"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    measured = measured.select("doc_id", "lang", *_COUNTS, log_perplexity.alias("log_perplexity"))
    return measured.withColumn("base_failed", failed)


def bands(measured: DataFrame) -> DataFrame:
    """lang, lower and upper log perplexity; the band of all documents has no language. `LANGUAGES` + 1 rows at most."""
    good = measured.filter(~F.col("base_failed"))
    bins = good.groupBy("lang", F.floor(F.col("log_perplexity") * 100).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # Languages come in any number, so they are counted before bins of some are looked at.
    sizes = bins.groupBy("lang").agg(F.sum("n").alias("size"))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    own = sizes.filter(F.col("lang").isNotNull() & (F.col("size") * LANGUAGES >= total)).select("lang")
    of_own = bins.join(F.broadcast(own), "lang").select("lang", "bin", "n")
    of_all = bins.groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "bin", "n")
    so_far = Window.partitionBy("lang").orderBy("bin")
    whole = Window.partitionBy("lang")
    shares = of_own.unionByName(of_all).select(
        "lang", "bin", (F.sum("n").over(so_far) / F.sum("n").over(whole)).alias("share")
    )

    def quantile(share: float):
        return F.min(F.when(F.col("share") >= share, F.col("bin") + 0.5)) / 100

    edges = shares.groupBy("lang").agg(
        quantile(TAIL).alias("low"), quantile(0.5).alias("middle"), quantile(1 - TAIL).alias("high")
    )
    reach = WIDTH * F.greatest(F.col("high") - F.col("middle"), F.col("middle") - F.col("low"), F.lit(0.01))
    return edges.select("lang", (F.col("middle") - reach).alias("lower"), (F.col("middle") + reach).alias("upper"))


def judged(measured: DataFrame) -> DataFrame:
    """One row per document measured: the counts, base_failed, kept, and perplexity with the band it was held against."""
    measured = checkpointed(measured)
    known = checkpointed(bands(measured))
    shared = known.filter(F.col("lang").isNull()).first()
    joined = measured.join(F.broadcast(known.filter(F.col("lang").isNotNull())), "lang", "left")
    if shared:
        joined = joined.withColumns({name: F.coalesce(name, F.lit(shared[name])) for name in ("lower", "upper")})
    inside = F.col("log_perplexity").between(F.col("lower"), F.col("upper"))
    return joined.select(
        "doc_id",
        *_COUNTS,
        "base_failed",
        F.coalesce(~F.col("base_failed") & inside, F.lit(False)).alias("kept"),
        *(F.exp(name).alias(alias) for name, alias in (("log_perplexity", "perplexity"), ("lower", "lower"), ("upper", "upper"))),
    )


def quality_rules(docs: DataFrame) -> DataFrame:
    """Every document judged by the model of the half of the texts that it is not in."""
    half = F.pmod(F.xxhash64(text_of()), F.lit(2))
    one, other = docs.filter(half == 0), docs.filter(half == 1)
    return judged(measures(one, train(other)).unionByName(measures(other, train(one))))
