"""Repeated passages against a plain walk over all windows; the FM-index and the segments by themselves."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from trovex.llm import repeats
from trovex.llm.fm_index import FmIndex, WaveletMatrix
from trovex.llm.segments import Hashes, segments

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, window):
    """Rows (doc_id, text) in order of doc_id; rows of one doc_id must have one text."""
    seen, out = {}, Counter()
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if seen.setdefault(tuple(words[i : i + window]), (doc_id, i)) != (doc_id, i):
                gone[i : i + window] = [True] * window
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out[doc_id, len(words), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()] += rows.count((doc_id, text))
    return out


def passages(seed=3, n=150):
    """Texts that share passages, copies, near copies, periods and repeats of their own."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    shared = [[rng.choice(words) for _ in range(rng.choice([19, 20, 21, 60]))] for _ in range(5)]
    rows, base = [], [rng.choice(words) for _ in range(70)]
    for i in range(n):
        text = []
        for _ in range(rng.randrange(4)):
            text += rng.choice(shared) if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randrange(40))]
        if i % 3 == 0:  # near copies
            text = list(base)
            text[rng.randrange(len(text))] = f"x{i}"
        if i % 20 == 1:
            text = ["a", "b", "c"] * rng.randrange(60) + text + text
        rows.append((i * 2 if i else None, rng.choice([" ", "\n"]).join(text)))
    return [*rows, (1001, None), (1002, ""), (1003, " \t"), (1005, "z " * 3000), rows[9], rows[9]]


@pytest.mark.parametrize("heavy", [64, 2])
def test_removed_words(spark, monkeypatch, heavy):
    monkeypatch.setattr(repeats, "HEAVY", heavy)
    rows = passages()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, hash long, runs int").repartition(5)
    got = repeats.removed(docs)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert Counter(map(tuple, got.collect())) == plain(rows, 20)


def test_query_on_odd_documents(docs, rows):
    assert Counter(map(tuple, repeats.removed(docs).collect())) == plain([r[:2] for r in rows], 20)


def test_cleaned_texts(docs, rows):
    """Texts without repeats stay as they are, and every column stays."""
    got = repeats.cleaned(docs)
    assert got.columns == docs.columns
    want = {}
    for r in rows:
        want.setdefault(r[0], r)
    removed = {r[0]: r for r in plain([r[:2] for r in rows], 20)}
    for r in got.collect():
        n = removed[r.doc_id][2]
        assert r.text == want[r.doc_id][1] if not n else len(WORD.findall(r.text)) == removed[r.doc_id][1] - n
        assert r.row_number == want[r.doc_id][5]


def test_no_documents(no_docs):
    assert repeats.removed(no_docs).collect() == []


def test_equal_doc_ids_with_other_texts(spark):
    """They are documents of their own, in one fixed order: of two equal passages exactly one stays."""
    passage = " ".join(f"p{i}" for i in range(30))
    docs = spark.createDataFrame([(7, f"{passage} one"), (7, f"{passage} two")], "doc_id long, text string")
    assert sorted(r.n_removed for r in repeats.removed(docs).collect()) == [0, 30]


def test_index_finds_earlier_windows():
    rng = np.random.default_rng(1)
    for _ in range(40):
        pieces = [rng.integers(1, 4, rng.integers(1, 40)) for _ in range(rng.integers(1, 12))]
        codes = np.concatenate([np.append(p, 0) for p in pieces])
        ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
        begins, depth = ends - [len(p) for p in pieces], int(rng.integers(2, 9))
        seen, want = set(), np.zeros(len(codes), bool)
        for b, e in zip(begins, ends, strict=True):
            for i in range(b, e - depth + 1):
                want[i] = tuple(codes[i : i + depth]) in seen
                seen.add(tuple(codes[i : i + depth]))
        assert (FmIndex(codes, 4, depth).repeated(codes, begins, ends) == want).all()


def test_wavelet_ranks():
    codes = np.random.default_rng(2).integers(0, 37, 1000)
    matrix, at = WaveletMatrix(codes, 37), np.arange(1001)
    for c in range(37):
        assert (matrix.rank(np.full(1001, c), at) == np.concatenate([[0], np.cumsum(codes == c)])).all()


def test_segments_hold_every_window_once_and_equal_windows_share_anchors():
    rng = random.Random(4)
    texts = [[rng.choice("abcde") for _ in range(rng.randrange(80))] for _ in range(40)] + [["a"] * 200, ["a", "b"] * 90]
    h = Hashes().of([w for t in texts for w in t])
    ends = np.cumsum([len(t) for t in texts])
    for heavy in (None, np.sort(segments(h, ends, 8, 3)[3][:5])):
        anchors, contents, windows = {}, {}, 0
        for o, s, n, a, c in zip(*segments(h, ends, 8, 3, heavy), strict=True):
            windows += n
            assert contents.setdefault((a, c), texts[o][s : s + n + 7]) == texts[o][s : s + n + 7]
            own = [tuple(texts[o][i : i + 8]) for i in range(s, s + n)]
            assert len(set(own)) == n
            for w in own:
                assert anchors.setdefault(w, a) == a
        assert windows == sum(max(0, len(t) - 7) for t in texts)
