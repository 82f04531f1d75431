"""Passages of benchmark items in documents, by winnowing.

The hash of every run of `GRAM` words is taken, and of every `SLIDE` neighbouring
hashes the least is the fingerprint of the `GRAM + SLIDE - 1 = WINDOW` words that
they span. Equal spans of that many words have equal fingerprints, so joining
those of documents and items finds every shared span of a window or more. Only
documents with a shared fingerprint go on; there each shared fingerprint is
extended to its window, and the words themselves are compared.

An item of fewer words than a window, but not none, is one window of all its
words; such windows are looked for by the hash of so many words.

All of it is DataFrame functions. The items' fingerprints are broadcast when
there are at most `BROADCAST_ROWS`, else both sides are shuffled, with Spark
splitting the partitions of a frequent fingerprint.

A null text has no words. Rows of the benchmark that share an item_id are one
item; an item without an id marks words but is not listed. Rows of documents
that share doc_id and text have the same result. Empty tables are fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hackney.llm.common import checkpointed, keyed_texts, text_of, without_rows

WINDOW = 10
GRAM = 5
SLIDE = WINDOW - GRAM + 1
#: Rows of 12 bytes that are broadcast at most.
BROADCAST_ROWS = 1_000_000
# What stands between words once A to Z are in lower case.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _BETWEEN), "")


def _fingerprinted(rows: DataFrame, short: list[int]) -> DataFrame:
    """Adds `marks`: for each start of a window its width and fingerprint; needs the column `words`."""
    hashed = rows.withColumn("hashes", F.expr("transform(words, word -> xxhash64(word))"))
    gram = ", ".join(f"get(hashes, i + {k})" for k in range(GRAM))
    grams = f"if(size(hashes) >= {WINDOW}, transform(sequence(0, size(hashes) - {GRAM}), i -> xxhash64({gram})), array())"
    least = ", ".join(f"get(grams, i + {k})" for k in range(SLIDE))
    marks = f"if(size(grams) > 0, transform(sequence(0, size(grams) - {SLIDE}), i -> least({least})), cast(array() as array<bigint>))"
    out = hashed.withColumn("grams", F.expr(grams)).withColumn("marks", F.expr(marks)).drop("grams")
    for width in short:
        run = ", ".join(f"get(hashes, i + {k})" for k in range(width))
        out = out.withColumn(
            f"short_{width}",
            F.expr(
                f"if(size(hashes) >= {width}, transform(sequence(0, size(hashes) - {width}), i -> xxhash64({run})), "
                "cast(array() as array<bigint>))"
            ),
        )
    return out.drop("hashes")


def _all_marks(short: list[int]) -> Column:
    """Distinct (width, fingerprint) of a row."""
    parts = [F.expr(f"transform(array_distinct(marks), mark -> struct({WINDOW} as width, mark as mark))")]
    parts += [F.expr(f"transform(array_distinct(short_{n}), mark -> struct({n} as width, mark as mark))") for n in short]
    return F.concat(*parts)


def _placed_marks(short: list[int]) -> Column:
    """(start, width, fingerprint) of every window of a row."""
    parts = [F.expr(f"transform(marks, (mark, i) -> struct(i as start, {WINDOW} as width, mark as mark))")]
    parts += [F.expr(f"transform(short_{n}, (mark, i) -> struct(i as start, {n} as width, mark as mark))") for n in short]
    return F.concat(*parts)


def _windows(benchmark: DataFrame) -> DataFrame:
    """Distinct (item, width, mark, span) of the items; a span is the window's words joined by a space."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(text_of()).alias("words"))
    long = _fingerprinted(items.filter(F.size("words") >= WINDOW), [])
    placed = long.select(
        "item",
        F.explode(
            F.expr(
                f"transform(marks, (mark, i) -> struct({WINDOW} as width, mark as mark, "
                f"array_join(slice(words, i + 1, {WINDOW}), ' ') as span))"
            )
        ).alias("w"),
    ).select("item", "w.*")
    few = items.filter((F.size("words") > 0) & (F.size("words") < WINDOW))
    parts = []
    for width in range(1, WINDOW):
        run = F.xxhash64(*(F.xxhash64(F.get("words", F.lit(k))) for k in range(width)))
        parts.append(
            few.filter(F.size("words") == width).select(
                "item", F.lit(width).alias("width"), run.alias("mark"), F.array_join("words", " ").alias("span")
            )
        )
    for part in parts:
        placed = placed.unionByName(part)
    return placed.distinct()


def _bounded(frame: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(frame) if rows <= BROADCAST_ROWS else frame


def hits(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Every window of an item that occurs in a document (key, tie, start, width, span); all windows, and their number."""
    windows = checkpointed(_windows(benchmark))
    short = sorted(row["width"] for row in windows.select("width").filter(F.col("width") < WINDOW).distinct().collect())
    marks = windows.select("width", "mark").distinct()
    count = windows.count()
    rows = keyed_texts(docs).select("key", "tie", words_of(F.col("text")).alias("words"))
    every = _fingerprinted(rows, short).select("key", "tie", F.explode(_all_marks(short)).alias("m"))
    shared = every.select("key", "tie", "m.width", "m.mark").join(_bounded(marks, count), ["width", "mark"], "left_semi")
    found = checkpointed(shared.select("key", "tie").distinct())
    candidates = rows.join(_bounded(found, found.count()), ["key", "tie"], "left_semi").dropDuplicates(["key", "tie"])
    placed = _fingerprinted(candidates, short).select("key", "tie", "words", _placed_marks(short).alias("placed"))
    spans = placed.select(
        "key",
        "tie",
        F.explode(
            F.expr("transform(placed, p -> struct(p.start as start, p.width as width, p.mark as mark, "
                "array_join(slice(words, p.start + 1, p.width), ' ') as span))")
        ).alias("p"),
    ).select("key", "tie", "p.*")
    extended = spans.join(
        _bounded(windows.select("width", "mark", "span").distinct(), count), ["width", "mark", "span"], "left_semi"
    )
    return checkpointed(extended.select("key", "tie", "start", "width", "span")), windows, count


def _covered(spans: str) -> Column:
    """Words in the union of sorted (start, width)."""
    return F.expr(
        f"aggregate({spans}, named_struct('end', 0, 'n', 0L), (acc, s) -> named_struct("
        "'end', greatest(acc.end, s.start + s.width), "
        "'n', acc.n + greatest(0, s.start + s.width - greatest(acc.end, s.start))), acc -> acc.n)"
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row."""
    found, windows, count = hits(docs, benchmark)
    places = found.groupBy("key", "tie").agg(F.sort_array(F.collect_set(F.struct("start", "width"))).alias("spans"))
    covered = places.select("key", "tie", _covered("spans").cast("long").alias("n_hit"))
    listed = (
        found.select("key", "tie", "width", "span")
        .distinct()
        .join(_bounded(windows.select("width", "span", "item").distinct(), count), ["width", "span"])
        .filter(F.col("item").isNotNull())
        .groupBy("key", "tie")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    verdicts = checkpointed(covered.join(listed, ["key", "tie"], "left"))
    rows = keyed_texts(docs).select("doc_id", "key", "tie", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.join(verdicts, ["key", "tie"], "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` in which no window of an item occurs, with all their columns."""
    found, _, _ = hits(docs, benchmark)
    return without_rows(docs, checkpointed(found.select("key", "tie").distinct()))
