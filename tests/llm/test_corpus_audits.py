"""Source divergence and the Merkle manifest against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from trovex.llm import divergence, manifest

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree long, player int, term string"


def plain_divergences(rows, told=200):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = Counter()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= 3]

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1000000000 * (c[t] + 1) // (n + len(kept)) for t in kept}

        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (p[s][t] - whole[t]) ** 2 // whole[t]) for t in kept if counts[lang, s][t] and p[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, told)):
                for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out[lang, s, part, item, value, rank] += 1
    return out


def test_divergences_of_odd_documents(docs, rows):
    got = divergence.divergences(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, got.collect())) == plain_divergences(rows)


@pytest.mark.parametrize(("sources", "slice_rows", "held"), [(1, 65_536, 300_000), (7, 40, 50), (19, 100, 300_000)])
def test_divergences_with_many_sources_and_slices(spark, monkeypatch, sources, slice_rows, held):
    """More sources than players, several slices, tasks that hand counts on early, groups and a language without kept terms."""
    monkeypatch.setattr(divergence, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "WORDS", held)
    rng = random.Random(sources)
    words = [f"{a}{b}" for a in "abcdeÉé" for b in "VWXYzñ"]
    rows = [(i, " ".join(rng.choice(words[: 6 + i % 37]) for _ in range(rng.randrange(30))), "en", f"s{i % sources}", 1, 2, 3, "x") for i in range(120)]
    rows += [(900 + i, f"once{'xyz'[i]}", "odd", f"o{i}", 1, 2, 3, "x") for i in range(3)] + [(950, "1 2 3", "en", "blank", 1, 2, 3, "x"), rows[0], rows[0]]
    got = divergence.divergences(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert Counter(map(tuple, got.collect())) == plain_divergences(rows)


def test_no_documents_diverge(no_docs):
    assert divergence.divergences(no_docs).collect() == []


@pytest.mark.parametrize("players", range(1, 9))
def test_every_two_players_meet_once(players):
    rounds = divergence.tournament(players)
    met = [frozenset(pair) for pairs in rounds for pair in pairs]
    assert Counter(met) == Counter(frozenset((a, b)) for a in range(players) for b in range(a))
    assert all(len({x for pair in pairs for x in pair}) == 2 * len(pairs) for pairs in rounds)


def digest(parts):
    return hashlib.sha256(parts.encode()).hexdigest()


def climbed(level):
    """All levels of a tree, from its leaves on."""
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_manifest(rows):
    def leaf(r, text):
        return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))

    by_source = defaultdict(list)
    for r in rows:
        cut = r[1] if r[1] is None or r[0] is None or zlib.crc32(str(r[0]).encode()) % 2 else r[1].replace("\n", "")
        by_source[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, cut), r[0]))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = [climbed([x[2] for x in sorted(by_source[s])]) for s in names]
    top = climbed([t[-1][0] for t in trees])
    out = Counter()
    for k, s in enumerate(names):
        for i, x in enumerate(sorted(by_source[s])):
            siblings, folded = [], x[3]
            for levels, at in ((trees[k], i), (top, k)):
                for level in levels[:-1]:
                    run, own = level[at // 3 * 3 : at // 3 * 3 + 3], at % 3
                    siblings += run[:own] + run[own + 1 :]
                    folded = digest("".join([*run[:own], folded, *run[own + 1 :]]))
                    at //= 3
            out[x[4], x[2], trees[k][-1][0], top[-1][0], digest("".join(siblings)), folded, folded == top[-1][0]] += 1
    return out


def test_manifest_of_odd_documents(docs, rows):
    got = manifest.verified(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.collect())) == plain_manifest(rows)


@pytest.mark.parametrize("sizes", [[1], [1, 2, 3, 4], [243, 244, 729, 1, 30], [2000, *[1] * 260]])
def test_manifest_of_many_sizes(spark, sizes):
    """Lone leaves, full blocks, one leaf more than a block, and more sources than a block holds."""
    rows = [(100_000 * s + i, f"line {i % 7}\nline\n", "en", f"s{s}" if s else None, 5, 1, 2, "x") for s, n in enumerate(sizes) for i in range(n)]
    rows += [rows[0]] * 3  # repeated rows
    got = manifest.verified(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert Counter(map(tuple, got.collect())) == plain_manifest(rows)


def test_manifest_without_documents(no_docs):
    assert manifest.verified(no_docs).collect() == []


def test_events_complete_in_any_order():
    """Digests climb as soon as a parent is whole, whatever the order; a lost child leaves its siblings unresolved."""
    rng = random.Random(1)
    for n in (2, 3, 4, 9, 10, 28, 100):
        leaves = [digest(str(i)) for i in range(n)]
        order = list(range(n))
        rng.shuffle(order)
        partial = manifest.Partial(manifest.depth_of(n))
        out = [x for i in order for x in partial.met(0, n, 0, i, leaves[i])]
        assert out == [(0, n, manifest.depth_of(n), 0, climbed(leaves)[-1][0])] and not list(partial.unresolved())
        out = [x for i in order[1:] for x in partial.met(0, n, 0, i, leaves[i])]
        assert out == [] and list(partial.unresolved())
