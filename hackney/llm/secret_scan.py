"""Secrets in texts: three fixed patterns, and random strings that no pattern names.

Two Markov models of neighbouring characters, one of secrets and one of ordinary
identifiers, words and numbers, are compared by the logarithm of their likelihood
ratio. A run of 16 or more characters of a key's alphabet, clear of the patterns'
matches, is a secret when the ratio is high enough as a sum and per character.

The models learn from labelled samples: strings with a flag. `samples` labels the
corpus itself, all of it, by the patterns: what they match is secret, other runs
are ordinary. Only counts of character pairs leave a task. The model of secrets
is a mixture with even chances, so that keys of an alphabet that no sample had
can be told, also when there is no sample at all.

Positions count code points, ends are exclusive. Null and empty texts have no
spans; rows that share a doc_id are scanned one by one; an empty table gives an
empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hackney.llm.common import slices, texts

# The patterns and the least lengths of what they find.
_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LEAST_VALUE, _LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "random")

#: What a model reads: characters of keys; all else ends a run.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SAMPLE = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Nats per character, and in all, from which a run is a secret.
LEAST_MEAN, LEAST_SUM = 0.7, 14.0
#: Share of even chances in the model of secrets.
EVEN = 0.2

_SIZE = len(ALPHABET) + 1  # the last code is the edge of a run
_CODES = np.full(256, _SIZE - 1, np.int64)
_CODES[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(_SIZE - 1)

Span = tuple[int, int, int]  # kind, start, end


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """Matches of the patterns: kind, start, end and the secret part; by start, then kind."""
    found = [(0, *m.span(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= _LEAST_VALUE]
    found += [(1, *m.span(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= _LEAST_ACCESS]
    found += [(2, *m.span(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda span: (span[1], span[0]))


def _clear(text: str, pattern: re.Pattern, base: list) -> Iterator[re.Match]:
    """Matches that do not touch a base span."""
    if not base:
        yield from pattern.finditer(text)
        return
    starts = [start for _, start, _, _ in base]
    ends = list(itertools.accumulate((end for _, _, end, _ in base), max))
    for match in pattern.finditer(text):
        before = bisect.bisect_left(starts, match.end())
        if not before or ends[before - 1] <= match.start():
            yield match


def pair_codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the neighbouring characters of all strings, edges included, and where each string's begin."""
    letters = _CODES[np.frombuffer(("\0" + "\0".join(strings) + "\0").encode("ascii", "replace"), np.uint8)]
    starts = np.cumsum([0, *(len(string) + 1 for string in strings[:-1])])
    return letters[:-1] * _SIZE + letters[1:], starts


class Model:
    """Log-likelihood ratio of each pair of neighbours."""

    def __init__(self, secret: np.ndarray, ordinary: np.ndarray):
        """From counts of pairs in labelled samples."""
        chances = (secret + 1e-9).reshape(_SIZE, _SIZE)
        chances = (1 - EVEN) * chances / chances.sum(1, keepdims=True) + EVEN / _SIZE
        if not secret.any():
            chances = np.full((_SIZE, _SIZE), 1 / _SIZE)
        usual = (ordinary + 0.5).reshape(_SIZE, _SIZE)
        usual = usual / usual.sum(1, keepdims=True)
        self.ratio = (np.log(chances) - np.log(usual)).ravel()

    def ratios(self, strings: list[str]) -> np.ndarray:
        """Sum over each string; the edges of a run say nothing of what is in it and are left out."""
        if not strings:
            return np.zeros(0)
        codes, starts = pair_codes(strings)
        inner = (codes // _SIZE < _SIZE - 1) & (codes % _SIZE < _SIZE - 1)
        return np.add.reduceat(np.where(inner, self.ratio[codes], 0.0), starts)

    def is_secret(self, strings: list[str]) -> np.ndarray:
        ratios, lengths = self.ratios(strings), np.array([len(string) for string in strings])
        return (ratios >= LEAST_SUM) & (ratios >= LEAST_MEAN * lengths)


def _tables(strings: Iterable[tuple[list[str], list[str]]]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, _SIZE * _SIZE), np.int64)
    for kinds in strings:
        for table, some in zip(counts, kinds, strict=True):
            if some:
                table += np.bincount(pair_codes(some)[0], minlength=_SIZE * _SIZE)
    used = np.flatnonzero(counts.any(0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.array(counts[0, used], pa.int64()), pa.array(counts[1, used], pa.int64())],
        names=["pair", "secret", "ordinary"],
    )


def _model(tables: DataFrame) -> Model:
    """Adds up the tasks' tables; the sum has a row per pair of characters at most."""
    rows = tables.groupBy("pair").agg(F.sum("secret").alias("secret"), F.sum("ordinary").alias("ordinary")).collect()
    counts = np.zeros((2, _SIZE * _SIZE))
    for row in rows:
        counts[:, row["pair"]] = row["secret"], row["ordinary"]
    return Model(counts[0], counts[1])


def train(samples: DataFrame) -> Model:
    """From rows of `sample` (string) and `secret` (boolean); rows with a null are passed over."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def kinds():
            for batch in batches:
                rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
                yield [s for s, secret in rows if secret], [s for s, secret in rows if not secret]

        yield from _tables(kinds())

    return _model(samples.select("sample", "secret").dropna().mapInArrow(count, "pair int, secret long, ordinary long"))


def train_on(docs: DataFrame) -> Model:
    """From all texts, labelled by the patterns."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def kinds():
            for batch, _, _ in slices(batches):
                secret, ordinary = [], []
                for text in batch.column("text").to_pylist():
                    base = base_spans(text)
                    secret += [value for _, _, _, value in base]
                    ordinary += [match[0] for match in _clear(text, _SAMPLE, base)] if base else _SAMPLE.findall(text)
                yield secret, ordinary

        yield from _tables(kinds())

    return _model(texts(docs).select("text").mapInArrow(count, "pair int, secret long, ordinary long"))


def scan(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, of one text."""
    return _scan_all([text], model)[0]


def _scan_all(texts_: list[str], model: Model) -> list[tuple[list[Span], list[Span]]]:
    base, runs, owners = [], [], []
    for i, text in enumerate(texts_):
        base.append(base_spans(text))
        new = list(_clear(text, _CANDIDATE, base[-1]))
        runs += new
        owners += [i] * len(new)
    random: list[list[Span]] = [[] for _ in texts_]
    if runs:
        for at in np.flatnonzero(model.is_secret([run[0] for run in runs])):
            random[owners[at]].append((3, *runs[at].span()))
    own = [[span[:3] for span in spans] for spans in base]
    return [(mine, sorted(mine + more, key=lambda span: (span[1], span[0]))) for mine, more in zip(own, random, strict=True)]


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in spans)


def secrets(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random of every row."""
    rows = texts(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in slices(batches):
            found = _scan_all(batch.column("text").to_pylist(), shared.value)
            counts = [[sum(span[0] == kind for span in spans) for _, spans in found] for kind in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array(count, pa.int64()) for count in counts[:3]),
                    pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string()),
                    pa.array([written(spans) for _, spans in found], pa.string()),
                    pa.array(counts[3], pa.int64()),
                ],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
    )
