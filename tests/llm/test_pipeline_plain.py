"""The whole pipeline on a small corpus, each stage against a plain version of what it does with its own input."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_corpus_operators import WORD, plain_path, plain_statistics, plain_targets
from test_pairs import merged, shingles
from test_token_operators import BYTES, crc, library_ids

from trovex.llm import mixing, quality
from trovex.llm.common import stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=11, n=400):
    """Good texts, texts of symbols, repetitive and short texts, exact copies, near copies and chains of them."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randrange(2, 10))) for _ in range(800)]
    rows, bad = [], set()
    for i in range(n):
        kind = i % 10
        own = [rng.choice(words) for _ in range(rng.choice([60, 90, 150, 400]))]
        if kind == 0 and rows:
            own = rng.choice(rows)[1].split(" ")
        elif kind == 1 and rows:
            own = rng.choice(rows)[1].split(" ")
            own[rng.randrange(len(own))] = f"changed{i}"
        elif i % 20 == 2:  # few, as an anomaly is
            own = [x + rng.choice(["#", "$$", "|", "<>"]) for x in own]
            bad.add(i)
        elif kind == 3:
            own = own[: rng.randrange(1, 50)]
        elif kind == 4 and i % 20 == 4:
            own = own[:7] * 20
        elif i == 5:
            own = [rng.choice(words) for _ in range(3000)]
        rows.append((i, " ".join(own), "en", ["a", "a", "a", "b", "c", None][rng.randrange(6)], 0))
    return [(*r[:4], len(r[1])) for r in rows], bad


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(input, output) of each stage by name."""
    import corpus_pipeline as p

    rows, bad = corpus()
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], int(r[0] not in bad), 0) for r in rows if r[0] % 10 in (2, 5, 6, 7, 8, 9)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in p.STAGES:
        after = stored(stage(spark, docs, str(folder)), "plain")
        out[name] = docs.collect(), after.collect()
        docs = after
    return out, rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), str(folder)


def test_quality_stage(spark, stages):
    """Base rules by plain counts; path lengths by walking every tree with its sample of labelled rows."""
    out, rows, labels, folder = stages
    before, after = out["quality rules"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    known = quality.labelled(stored(quality.measured(docs), "statistics"), labels)
    forest = quality.fitted(known)
    draw = quality.drawn(known.where("fold <> 0"), quality.TREES * quality.SAMPLE, quality.F.xxhash64(quality.F.lit(quality.SEED), "doc_id"), "doc_id")
    sample = quality.features(np.array(draw.select(*quality.STATISTICS).collect(), np.int64))
    rng, grown = np.random.default_rng(quality.SEED), []
    for tree in forest.trees:
        own = sample[rng.choice(len(sample), forest.size, replace=False)]
        again = quality.grown(own, rng)
        assert (again.split == tree.split).all()
        grown.append(list(own))
    want = Counter()
    for r in before:
        n, _, _, _, repeated = plain_statistics(r.text or "")
        if n < 50 or 100 * repeated > 50 * n:
            continue
        x = quality.features(np.array([quality.statistics(r.text)], np.int64))[0]
        mean = np.mean([plain_path(x, s, t) for s, t in zip(grown, forest.trees, strict=True)])
        if 2.0 ** (-mean / quality.added(forest.size)) <= forest.threshold:
            want[r] += 1
    assert Counter(after) == want
    assert forest.threshold < 1  # labels told the kinds apart
    assert len([r for r in after if r.doc_id % 20 == 2]) < len([r for r in before if r.doc_id % 20 == 2]) / 5


def test_near_duplicate_stage(stages):
    before, after = stages[0]["near-duplicates"]
    sets = [shingles(r.text, 5) for r in before]
    pairs = [(i, j) for i, a in enumerate(sets) for j in range(i) if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j])]
    groups = merged(len(before), pairs)
    least = {}
    for r, g in zip(before, groups, strict=True):
        if g not in least or r.doc_id < least[g].doc_id:
            least[g] = r
    assert len(least) < len(before)
    assert Counter(after) == Counter(least.values())


def test_mixing_stage(stages):
    """Targets by plain resharing; texts are runs of words of their document, none more than twice."""
    before, after = stages[0]["source mix"]
    words = {r.doc_id: WORD.findall(r.text) for r in before}
    source, sizes, took = {r.doc_id: r.source for r in before}, Counter(), Counter()
    for r in before:
        sizes[r.source] += len(words[r.doc_id])
    each = Counter()
    for r in after:
        own = WORD.findall(r.text)
        each[r.doc_id] += len(own)
        took[r.source] += len(own)
        assert r.source == source[r.doc_id]
        assert r.n_chars == len(r.text)
        for line in r.text.split("\n"):
            assert f" {line} " in f" {' '.join(words[r.doc_id])} "
    assert all(n <= 2 * len(words[d]) for d, n in each.items())
    for s, t in plain_targets(sizes).items():
        assert abs(took[s] - t) <= max(0.02 * t, 2 * mixing.BLOCK)


def test_packing_stage(stages):
    """Pieces by the tokenizers library; sequences gapless, within their capacity, and as few as plain first fit needs or fewer."""
    before, after = stages[0]["packing"]
    want, lengths = Counter(), []
    for r, ids in zip(before, library_ids(BYTES, [r.text for r in before]), strict=True):
        ids = [*ids, 2]
        at = 0
        for piece, n in enumerate(([len(ids) % 1024] if len(ids) % 1024 else []) + [1024] * (len(ids) // 1024)):
            want[r.doc_id, piece, at, n, crc(ids[at : at + n])] += 1
            lengths.append(n)
            at += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in after) == want
    bins = defaultdict(list)
    for r in after:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        items.sort()
        assert [o for o, _ in items] == [sum(n for _, n in items[:k]) for k in range(len(items))]
        assert sum(n for _, n in items) <= 1024
    fills: list[int] = []
    for n in sorted(lengths, reverse=True):
        k = next((k for k, f in enumerate(fills) if f + n <= 1024), None)
        if k is None:
            fills.append(n)
        else:
            fills[k] += n
    assert -(-sum(lengths) // 1024) <= len(bins) <= len(fills)


def test_run_is_its_stages(spark, stages):
    import corpus_pipeline as p

    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(key, p.run(spark, stages[3]).collect())) == Counter(map(key, stages[0]["packing"][1]))
