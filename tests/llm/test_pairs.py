"""The Jaccard join and the vector join against all pairs; components against a plain union of sets."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trovex.llm import jaccard_join, vector_dedup
from trovex.llm.components import components
from trovex.llm.jaccard_join import Rule

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def merged(n, pairs):
    at = list(range(n))

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        at[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def shingles(text, n):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)])


def plain_components(rows, rule):
    sets = [shingles(r[1], rule.n) for r in rows]
    pairs = [(i, j) for i, a in enumerate(sets) for j in range(i) if a and sets[j] and 100 * len(a & sets[j]) >= rule.percent * len(a | sets[j])]
    groups = merged(len(rows), pairs)
    out = Counter()
    for i, r in enumerate(rows):
        ids = [x[0] for x, g in zip(rows, groups, strict=True) if g == groups[i] and x[0] is not None]
        out[r[0], len(sets[i]), min(ids) if sets[i] and ids else r[0]] += 1
    return out


@pytest.mark.parametrize("rule", [Rule(3, 90), Rule(5, 80), Rule(1, 60)])
def test_jaccard_join(docs, rows, rule):
    assert Counter(map(tuple, jaccard_join.joined(docs, rule).collect())) == plain_components(rows, rule)


def test_jaccard_join_of_chains(spark):
    """Texts that change a little at a time: one component by links, though its ends are far apart; and one shared passage."""
    rng = random.Random(2)
    words = [f"v{i}" for i in range(2000)]
    text = rng.sample(words, 120)
    common = " ".join(rng.sample(words, 30))
    rows = []
    for i in range(60):
        text = list(text)
        text[rng.randrange(len(text))] = f"x{i}"
        rows.append((i + 1, " ".join(text)))
    rows += [(100 + i, common + " " + " ".join(rng.sample(words, 40))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, jaccard_join.joined(df, Rule(3, 90)).collect()))
    assert got == plain_components(rows, Rule(3, 90))


def just_under(n, words=175, changes=2, seed=7):
    """Copies of one text with a few words changed each: most pairs stay just under 0.8 by shingles of five."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    rows = []
    for i in range(n):
        own = list(base)
        for k in range(changes):
            own[rng.randrange(words)] = f"x{i}y{k}"
        rows.append((i + 1, " ".join(own)))
    return rows


def counted_components(rows, rule):
    """As plain_components, by a matrix of the shingles that several texts have."""
    sets = [shingles(r[1], rule.n) for r in rows]
    several = {x: k for k, x in enumerate(x for x, c in Counter(x for s in sets for x in s).items() if c > 1)}
    has = np.zeros((len(rows), len(several)), np.float32)
    for i, s in enumerate(sets):
        has[i, [several[x] for x in s if x in several]] = 1
    shared, size = (has @ has.T).astype(int), np.array(list(map(len, sets)))
    linked = np.argwhere(100 * shared >= rule.percent * (size[:, None] + size - shared))
    groups = merged(len(rows), linked.tolist())
    least = {}
    for r, g in zip(rows, groups, strict=True):
        least[g] = min(r[0], least.get(g, r[0]))
    return Counter((r[0], int(n), least[g]) for r, n, g in zip(rows, size, groups, strict=True))


def test_rows_grow_with_the_members_not_with_pairs(spark):
    """2,000 near copies, most of whose two million pairs are just too far apart to link, and thousands of which the sketches let through."""
    rule, rows = Rule(5, 80), just_under(2000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sketched = jaccard_join.stored(jaccard_join.sketches(df, rule), "sketches")
    members = jaccard_join.stored(jaccard_join.shared_parts(sketched), "members")
    blocks = members.select("key", "n").distinct().agg(F.sum(F.ceil(F.col("n") / jaccard_join.BLOCK))).first()[0]
    assert blocks < members.count() / 10
    assert jaccard_join.near(members, sketched, rule).count() <= 2 * members.count()
    assert Counter(map(tuple, jaccard_join.joined(df, rule).collect())) == counted_components(rows, rule)


def test_links_by_shared_counts():
    """Every pair of sets, with elements of one, some or all; across two blocks and within one."""
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.choice(np.arange(1, 60, dtype=np.uint64), rng.integers(1, 50))) for _ in range(40)]
    rule = Rule(3, 60)
    want = np.array([[100 * len(np.intersect1d(a, b)) >= 60 * len(np.union1d(a, b)) for b in sets] for a in sets])
    assert (jaccard_join.links(sets, 40, rule) == want).all()
    assert (jaccard_join.links(sets, 15, rule) == want[:15, 15:]).all()


def test_blocks_of_few_elements(spark, docs, rows, monkeypatch):
    """Clusters and parts cut into many blocks give the same components."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    monkeypatch.setattr(jaccard_join, "ELEMENTS", 100)
    assert Counter(map(tuple, jaccard_join.joined(docs, Rule(5, 80)).collect())) == plain_components(rows, Rule(5, 80))


def test_half_of_all_rows_are_one_text_without_an_id(spark):
    rows = [(None if i % 2 else i, "same words for every one of these" if i % 2 else f"text number {i} of its own kind") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, jaccard_join.joined(df, Rule(3, 90)).collect()))
    assert got[None, 5, None] == 200
    assert sum(got.values()) == 400
    assert jaccard_join.one_of_each(df.withColumn("row", F.lit(1)).withColumn("_row", F.lit(2)), Rule(5, 80)).count() == 201


def test_sketches_bound_the_difference():
    """At every width, and between sets of other widths, sketches never differ in more bits than the sets do in elements."""
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 30_000).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, n, replace=False)) for n in (1, 900, 2048, 2049, 5000, 16_000)]
    sets += [np.unique(np.concatenate([s[: len(s) - len(s) // 20], rng.choice(pool, len(s) // 20 + 1)])) for s in sets]
    raw = [jaccard_join.bit_sketch(s) for s in sets]
    rows = jaccard_join.BitRows(pa.array(raw, pa.binary()))
    for i, a in enumerate(sets):
        found = rows.apart(i, np.arange(len(sets)))
        for j, b in enumerate(sets):
            differ = len(np.setxor1d(a, b, assume_unique=True))
            assert found[j] == jaccard_join.sketch_distance(raw[i], raw[j]) <= differ
    assert jaccard_join.sketch_distance(raw[4], raw[5]) > 1000


def test_one_of_each(docs, rows):
    rule = Rule(5, 80)
    kept = jaccard_join.one_of_each(docs.withColumn("_row_number", F.lit(1)), rule)
    assert kept.columns == [*docs.columns, "_row_number"]
    sets = [shingles(r[1], rule.n) for r in rows]
    pairs = [(i, j) for i, a in enumerate(sets) for j in range(i) if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j])]
    groups = merged(len(rows), pairs)
    told = Counter((r[0], r[1]) for r in rows)
    assert kept.count() == len(set(groups))
    for r in kept.collect():
        assert told[r.doc_id, r.text] > 0
    # where ids differ and are not null, the smallest stays
    own = [(r, g) for r, g in zip(rows, groups, strict=True)]
    for g in set(groups):
        ids = [r[0] for r, k in own if k == g]
        if None not in ids and len(set(ids)) == len(ids) > 1 and all(sum(r[0] == i for r in rows) == 1 for i in ids):
            assert {r.doc_id for r in kept.where(F.col("doc_id").isin(ids)).collect()} == {min(ids)}


def test_nothing_to_join(no_docs):
    assert jaccard_join.joined(no_docs, Rule(3, 90)).count() == 0
    assert jaccard_join.one_of_each(no_docs, Rule(5, 80)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(70)] + [(600, 600 + i) for i in range(50)]
    groups = merged(700, pairs)
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: groups[i] for p in pairs for i in p if any(i in q and q[0] != q[1] for q in pairs)}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 24))
    near = base[rng.integers(0, 40, 200)] + rng.normal(size=(200, 24)) * rng.uniform(0.05, 0.35, (200, 1))
    x = np.concatenate([base, near, base[:5] * 3.0])
    rows = [(i, [float(v) for v in np.float32(row)]) for i, row in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 24), (902, [float("nan"), *[1.0] * 23]), (903, [None, *[1.0] * 23]), (904, []), (905, [1.0, 2.0]), (906, [float("inf"), *[1.0] * 23])]
    return rows + [(907, rows[3][1]), (908, rows[3][1])]


def test_vector_links(spark, vectors):
    sound = [(i, np.array(v, float)) for i, v in vectors if v is not None and len(v) == 24 and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    x = np.stack([v / np.linalg.norm(v) for _, v in sound])
    near = x @ x.T >= 0.95
    ids = [i for i, _ in sound]
    groups = merged(len(ids), list(zip(*near.nonzero(), strict=True)))
    want = {i: (0, i) for i, _ in vectors}
    for k, i in enumerate(ids):
        want[i] = (int(near[k].sum()) - 1, min(j for j, g in zip(ids, groups, strict=True) if g == groups[k]))
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("size", F.lit(1)).withColumn("label", F.lit(0))
    rows = vector_dedup.linked(df).collect()
    assert len(rows) == len(vectors)
    found = sum(r.n_links for r in rows)
    assert all(r.n_links <= want[r.vec_id][0] for r in rows)
    assert found >= 0.98 * sum(n for n, _ in want.values())
    assert sum(r.component_id != want[r.vec_id][1] for r in rows) <= 2
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)


def test_no_vectors(spark):
    assert vector_dedup.linked(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    one = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in vector_dedup.linked(one).collect()] == [(1, 0, 1, True)]


@pytest.mark.parametrize(("rank", "width"), [(6, 512), (8, 768), (64, 64)])
def test_links_of_vectors_in_few_directions(spark, monkeypatch, rank, width):
    """Differences of near vectors point where the vectors do, not anywhere: nearly all links are found by index and probes."""
    monkeypatch.setattr(vector_dedup, "DIRECT", 0)
    rng = np.random.default_rng(rank)
    base = rng.normal(size=(2000, rank))
    near = base[rng.integers(0, 2000, 1500)]
    step = rng.normal(size=near.shape)
    near = near + step * (np.linalg.norm(near, axis=1) / np.linalg.norm(step, axis=1) * rng.uniform(0.05, 0.34, 1500))[:, None]
    x = np.concatenate([base, near]) @ np.linalg.qr(rng.normal(size=(width, rank)))[0].T
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = (x @ x.T >= 0.95).sum(1) - 1
    got = {r.vec_id: r.n_links for r in vector_dedup.linked(df).collect()}
    assert all(got[i] <= want[i] + 1 for i in got)
    assert sum(got.values()) >= 0.98 * want.sum() > 1000


@pytest.mark.parametrize("direct", [0, 1 << 21])
def test_vectors_of_several_lengths(spark, monkeypatch, direct):
    """Each length links within itself, by an index of its own or directly; no vector links with one of another length."""
    monkeypatch.setattr(vector_dedup, "DIRECT", direct)
    rng = np.random.default_rng(7)
    rows = []
    for width, n in ((5, 300), (24, 200), (3, 1), (7, 2)):
        base = rng.normal(size=(n, width))
        base[n // 2 :] = base[: n - n // 2] + rng.normal(size=(n - n // 2, width)) * 0.05
        rows += [(len(rows) + i, v) for i, v in enumerate(base)]
    rows += [(1000, rows[0][1]), (1001, rows[305][1])]
    near = {i: {j for j, w in rows if i != j and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.95} for i, v in rows}
    got = {r.vec_id: r.n_links for r in vector_dedup.linked(spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")).collect()}
    assert got == {i: len(n) for i, n in near.items()}


@pytest.mark.parametrize("width", [5, 12, 64])
def test_rounded_distances_lose_no_link(width):
    """With limits that rule nothing out, and with exact ones, 16-bit sums over 1, 4 and 8 subspaces find every link."""
    import pandas as pd

    rng = np.random.default_rng(width)
    base = rng.normal(size=(200, width))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.2])
    rows = pd.DataFrame({"vec_id": np.arange(400), "size": 1, "vector": [v.tobytes() for v in x]})
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = vector_dedup.fitted(x, 400, 0.95)
    index.lists = index.lists[:1]
    residual = x - index.lists[0]
    codes = index.residual_codes(residual)
    error = np.linalg.norm(residual - index.decoded(codes), axis=1)
    rows = rows.assign(home=0, probes=[[0]] * 400, codes=[c.tobytes() for c in codes])
    for limit in ((index.apart + error) ** 2 + 1e-4, np.full(400, 9.0)):
        got = vector_dedup.links_of(rows.assign(limit=limit), rows, 0, index, 0.95)
        assert got["n"].sum() == (x @ x.T >= 0.95).sum() - 400 > 100


def test_links_do_not_depend_on_the_number_of_vectors(spark, monkeypatch):
    """Links of a rare kind, which the index may miss, are found or missed alike, whether one task has the index or many."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(1500, 512))
    base[:, 0] = rng.normal(size=1500) * 22
    base /= np.linalg.norm(base, axis=1)[:, None]
    far = base[:150].copy()
    far[:, 0] += 0.28
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, far]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)

    def got(direct):
        monkeypatch.setattr(vector_dedup, "DIRECT", direct)
        return sorted(map(tuple, vector_dedup.linked(df).collect()))

    assert got(1 << 21) == got(0)


def test_tiny_and_huge_vectors_link_and_leave_others_alone(spark):
    x = np.random.default_rng(8).normal(size=(40, 12))
    rows = [*enumerate(x), (100, x[0] * 1e-200), (101, x[1] * 1e200), (102, x[2] * 2.0), (103, np.array([*[0.0] * 11, 5e-324]))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.linked(df).collect()}
    assert got == {i: (1, i % 100) if i < 3 or 99 < i < 103 else (0, i) for i, _ in rows}


def near_copies(n, seed):
    """Texts of 100 words: most differ in 3 words of their own, so they link; each fifth in 12, so it is just under the limit."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(n):
        own = list(base)
        for k, at in enumerate(rng.sample(range(100), 12 if i % 5 == 4 else 3)):
            own[at] = f"x{i}-{k}"
        rows.append((i, " ".join(own)))
    return rows


def test_sets_of_a_cluster_travel_about_once(spark, monkeypatch):
    """Near copies above and just under the limit: components by brute force, and copied sets about as the texts."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 64)
    plain, copied = jaccard_join.verified, []

    def counted(rows, rule):
        copied.append(rows.count())
        return plain(rows, rule)

    monkeypatch.setattr(jaccard_join, "verified", counted)
    sent = []
    for n in (300, 600):
        rows = near_copies(n, n)
        copied.clear()
        got = jaccard_join.joined(spark.createDataFrame(rows, "doc_id long, text string"), Rule(1, 80))
        assert Counter(map(tuple, got.collect())) == plain_components(rows, Rule(1, 80))
        assert len(copied) == 3  # within blocks, one of each component, members of different components
        sent.append(sum(copied))
    assert sent[1] < 3 * sent[0]


@pytest.mark.parametrize("block", [2, 5])
def test_components_across_blocks(spark, docs, rows, monkeypatch, block):
    """Every kind of link between blocks: within one, between representatives, and between other members of components."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(block)
    chain = [f"c{i}" for i in range(40)]
    texts = []
    for _ in range(60):  # long chains, whose ends are far apart
        chain[rng.randrange(40)] = f"c{rng.randrange(1000)}"
        texts.append(" ".join(chain))
    rng.shuffle(texts)
    more = [*[(5000 + i, t) for i, t in enumerate(texts)], *near_copies(40, 1)]
    assert Counter(map(tuple, jaccard_join.joined(spark.createDataFrame(more, "doc_id long, text string"), Rule(1, 90)).collect())) == plain_components(more, Rule(1, 90))
    assert Counter(map(tuple, jaccard_join.joined(docs, Rule(3, 90)).collect())) == plain_components(rows, Rule(3, 90))
