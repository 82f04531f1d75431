"""Every operator's query against brute force on rows of every odd kind, and on empty tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hackney.llm import bpe, components, quality, queries, secret_scan, token_counts
from hackney.llm.suffixes import permuted_common_prefixes, suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def result(spark, name, folder, *columns):
    return Counter(tuple(row) for row in queries.queries()[name](spark, folder).select(*columns).collect())


def removed(docs, parts, width):
    """For each row, which parts an earlier place's run of `width` covers; equal rows are one place."""
    seen, out = {}, []
    for doc_id, text, tie in docs:
        units = parts(text)
        gone = [False] * len(units)
        for i in range(len(units) - width + 1):
            place = (doc_id, tie, i)
            if seen.setdefault(units[i : i + width] if isinstance(units, bytes) else tuple(units[i : i + width]), place) != place:
                gone[i : i + width] = [True] * width
        out.append((units, gone))
    return out


def test_secrets(spark, given, docs):
    names = ["assign", "access", "hex"]
    wanted = Counter()
    for doc_id, text, _ in docs:
        pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
        found = [(m.start(), 0, m.end()) for m in re.finditer(pattern, text, re.I | re.A) if len(m[2]) > 5]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) > 19]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) > 23]
        written = ",".join(f"{names[kind]}:{start}:{end}" for start, kind, end in sorted(found))
        wanted[(doc_id, *(sum(f[1] == kind for f in found) for kind in range(3)), sha(written))] += 1
    assert result(spark, "op1_secret_scan", given, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == wanted


def test_random_string_is_told_from_identifiers(spark):
    words = ["configuration_parameter", "response_handler_factory", "background_worker_pool", "4795522935961213"]
    rng = random.Random(2)
    keys = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(80)]
    numbers = ["".join(rng.choice("0123456789") for _ in range(16)) for _ in range(200)]
    samples = [(w, False) for w in words * 50 + numbers] + [(key, True) for key in keys[1:]] + [(None, True), ("x", None)]
    model = secret_scan.train(spark.createDataFrame(samples, "sample string, secret boolean"))
    assert model.is_secret([keys[0], "parameter_configuration", "4412473014894482"]).tolist() == [True, False, False]


def test_word_windows(spark, given, docs):
    wanted = Counter()
    for (doc_id, _, _), (words, gone) in zip(docs, removed(docs, WORD.findall, 20), strict=True):
        wanted[(doc_id, len(words), sum(gone), sha(" ".join(w for w, g in zip(words, gone, strict=True) if not g)))] += 1
    assert result(spark, "op3_substring_dedup", given, "doc_id", "n_words", "n_removed", "kept_sha256") == wanted


def test_byte_strings(spark, given, docs):
    wanted = Counter()
    for (doc_id, _, _), (data, gone) in zip(docs, removed(docs, str.encode, 100), strict=True):
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and not before for g, before in zip(gone, [False, *gone], strict=False))
        wanted[(doc_id, len(data), sum(gone), spans, sha(kept))] += 1
    assert result(spark, "op8_suffix_dedup", given, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == wanted


def test_exact_copies(spark, given, docs):
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", text) for _, text, _ in docs]
    first, wanted = {}, Counter()
    for (doc_id, _, _), text in zip(docs, texts, strict=True):
        kept = text not in first
        first.setdefault(text, doc_id)
        wanted[(doc_id, first[text], texts.count(text), kept, sha(text))] += 1
    assert result(spark, "op5_exact_dedup", given, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == wanted


def near_components(docs, percent=85):
    sets = []
    for _, text, _ in docs:
        words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    part = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((part[i], part[j]))
                part = [low if p == high else p for p in part]
    return sets, part


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_components_of_links(spark, monkeypatch, block):
    monkeypatch.setattr(components, "BLOCK_EDGES", block)
    rng = random.Random(block)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(i, i + 1) for i in range(500, 560)]
    part = {node: node for link in links for node in link}
    for _ in part:
        for a, b in links:
            part[a] = part[b] = min(part[a], part[b])
    frame = spark.createDataFrame(links, "a long, b long").repartition(4)
    rows = components.connected(frame).collect()
    alone = {node for node in part if all(a == b for a, b in links if node in (a, b))}
    assert {row["node"]: row["component"] for row in rows} == {node: own for node, own in part.items() if node not in alone}
    assert len(rows) == len(part) - len(alone)
    a, b = components.stars(*np.array(links).T)
    assert {(int(u), int(v)) for u, v in zip(a, b)} == {(node, own) for node, own in part.items() if node != own}


def test_near_copies(spark, given, docs):
    sets, part = near_components(docs)
    wanted = Counter()
    for i, (doc_id, _, _) in enumerate(docs):
        first = docs[part[i]][0]
        wanted[(doc_id, len(sets[i]), first, doc_id == first)] += 1
    assert result(spark, "op7_near_dedup", given, "doc_id", "n_shingles", "component_id", "kept") == wanted


@pytest.mark.parametrize("name", ["op6_token_counts", "op9_bpe"])
def test_tokens(spark, given, docs, name):
    texts = [text for _, text, _ in docs]
    file = queries.COUNT_VOCABULARY if name == "op6_token_counts" else queries.CODE_VOCABULARY
    library = token_counts.load(queries.vocabulary(file))
    ids = [encoding.ids for encoding in library.encode_batch(texts, add_special_tokens=False)]
    if name == "op6_token_counts":
        wanted = Counter((d[0], len(d[1].encode()), len(x), len(x) > 512) for d, x in zip(docs, ids, strict=True))
        assert result(spark, name, given, "doc_id", "n_bytes", "n_tokens", "over_limit") == wanted
    else:
        wanted = Counter(
            (d[0], len(x), sha(np.array(x, "<u4").tobytes()), sha(library.decode(x, skip_special_tokens=False)))
            for d, x in zip(docs, ids, strict=True)
        )
        assert result(spark, name, given, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == wanted


def test_trees_agree_with_the_library():
    path = queries.vocabulary(queries.CODE_VOCABULARY)
    library, vocabulary = token_counts.load(path), bpe.Vocabulary(path)
    words = ["a", "the", "unbelievable", "zzzz" * 50, "ß", "ñandú", "x" * 63, "anthropomorphisation" * 9, "qwrtpsdf"]
    expected = [library.encode(word, add_special_tokens=False).ids for word in words]
    assert vocabulary.encode_words(words) == expected
    assert [vocabulary.encode_word(word.encode()) for word in words] == expected


def benchmark_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def benchmark_windows(spark, folder):
    """The items of every window of the benchmark."""
    windows = {}
    for row in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        words = benchmark_words(row.text)
        width = min(len(words), 10)
        for i in range(len(words) - width + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + width]), set()).add(row.item_id)
    return windows


def benchmark_hits(text, windows):
    """Words of the text, which of them are hit, and the items that hit."""
    words, hit, items = benchmark_words(text), set(), set()
    for window, owners in windows.items():
        for i in range(len(words) - len(window) + 1):
            if tuple(words[i : i + len(window)]) == window:
                hit |= set(range(i, i + len(window)))
                items |= {str(owner) for owner in owners if owner is not None}
    return words, hit, items


def test_benchmark_passages(spark, given, docs):
    windows = benchmark_windows(spark, given)
    wanted = Counter()
    for doc_id, text, _ in docs:
        words, hit, items = benchmark_hits(text, windows)
        wanted[(doc_id, len(words), len(hit), len(items), sha(",".join(sorted(items))), bool(hit))] += 1
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sum(n for row, n in wanted.items() if row[-1]) >= 10
    assert result(spark, "op10_decontaminate", given, *columns) == wanted


@pytest.mark.parametrize("name", ["op2_quality", "op4_language"])
def test_scores_of_every_row(spark, given, docs, name):
    rows = queries.queries()[name](spark, given).collect()
    assert Counter(row.doc_id for row in rows) == Counter(doc[0] for doc in docs)
    assert all(0 <= row.score <= 1 for row in rows)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    lang = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    found = queries.op4_language(spark, folder).filter("held_out").join(lang, "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    found = queries.op2_quality(spark, folder).filter("held_out").join(labels, "doc_id")
    assert found.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.9


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - {"pipeline"}))
def test_empty_tables(spark, empty, name):
    assert queries.queries()[name](spark, empty).count() == 0


def test_suffix_array_by_induced_sorting():
    rng = np.random.default_rng(3)
    for trial in range(200):
        text = rng.integers(0, rng.choice([1, 2, 4, 250]), rng.integers(0, 70)).astype(np.uint8)
        text = np.tile(text, rng.integers(1, 4))
        data = text.tobytes()
        order = suffix_array(text, 256).tolist()
        assert order == sorted(range(len(data)), key=lambda i: data[i:])
        shared = permuted_common_prefixes(text, np.array(order, int), 20)
        for a, b in zip(order, order[1:]):
            n = next((k for k in range(20) if data[a + k : a + k + 1] != data[b + k : b + k + 1] or b + k >= len(data)), 20)
            assert shared[b] == n


def test_pipeline_stages(spark, given, docs):
    """Each filtering stage keeps what its operator says, near copies from 0.8 on, with all columns; copies of a row go together."""
    table = spark.read.parquet(f"{given}/documents.parquet")
    key = ["doc_id", "text"]
    kept = {name: stage(spark, table, given) for name, stage in corpus_pipeline.STAGES[1:4]}
    assert all(frame.columns == table.columns for frame in kept.values())
    got = {name: Counter((row.doc_id, row.text or "") for row in frame.select(*key).collect()) for name, frame in kept.items()}
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", text) for _, text, _ in docs]
    first = [i for i, text in enumerate(texts) if text not in texts[:i]]
    assert got["exact_dedup"] == Counter(docs[i][:2] for i in first)
    sets, part = near_components(docs, 80)
    assert got["near_dedup"] == Counter(d[:2] for i, d in enumerate(docs) if docs[part[i]][:2] == d[:2] or not sets[i])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "encode"]


def test_pipeline_run(spark, given, docs):
    """The rows of the whole pipeline against its stages by brute force; texts are judged one at a time."""
    model = quality.train(spark.read.parquet(f"{given}/documents.parquet"), spark.read.parquet(f"{given}/labels.parquet"))
    good = [doc for doc in docs if model.score([memoryview(doc[1].encode())])[0] >= quality.KEEP_FROM]
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", text) for _, text, _ in good]
    single = [doc for i, doc in enumerate(good) if texts[i] not in texts[:i]]
    sets, part = near_components(single, 80)
    apart = [doc for i, doc in enumerate(single) if part[i] == i]
    windows = benchmark_windows(spark, given)
    clean = [doc for doc in apart if not benchmark_hits(doc[1], windows)[1]]
    assert 0 < len(clean) < len(apart) < len(single) < len(good) < len(docs)
    library = token_counts.load(queries.vocabulary(queries.CODE_VOCABULARY))
    wanted = Counter()
    for doc_id, text, _ in clean:
        ids = library.encode(text, add_special_tokens=False).ids
        wanted[(doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False)))] += 1
    assert result(spark, "pipeline", given, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == wanted


def test_pipeline_on_empty_tables(spark, empty):
    assert queries.queries()["pipeline"](spark, empty).count() == 0
