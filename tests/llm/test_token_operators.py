"""Token records, packing and trie counts against the libraries and plain Python."""

from __future__ import annotations

import itertools
import json
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trovex.llm import packing, records, token_counts
from trovex.llm.encoding import encoder, found

WORDS, BYTES, PIECES = (found(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def library_ids(path, texts):
    from tokenizers import Tokenizer

    return [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="latin-1"), st.sampled_from("ab '1 \n’中€ſK")), max_size=40), max_size=6))
@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_ids_are_the_librarys(path, texts):
    texts = [*texts, "<|endoftext|> x", "it's  two   spaces\n\n", "  lead", "tail  "]
    assert [x.tolist() for x in encoder(path).encode(texts)] == library_ids(path, texts)


def test_a_third_vocabulary_goes_to_the_library(tmp_path):
    """The byte vocabulary with another pre-tokenizer, which our patterns do not fit."""
    stated = json.loads(open(BYTES).read())
    stated["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(stated))
    texts = ["word and  more", "", "don't 123"]
    assert [x.tolist() for x in encoder(str(path)).encode(texts)] == library_ids(str(path), texts)
    assert encoder(BYTES).pieces is not None
    assert encoder(WORDS).lowered


def test_files_follow_the_bytes(spark, docs, rows, tmp_path, monkeypatch):
    size = sum(len((r[1] or "").encode()) for r in rows)
    monkeypatch.setattr(records, "FILE_BYTES", size // 9)
    path = str(tmp_path / "records")
    records.write_records(docs, path, WORDS, end_id=1)
    assert 7 <= len(list((tmp_path / "records" / "data").glob("part-*"))) <= 11
    assert records.read_digests(spark, path).count() == len(rows)


def test_records(spark, docs, rows, tmp_path):
    path = str(tmp_path / "records")
    records.write_records(docs, path, WORDS, end_id=1)
    got = [r.asDict() for r in records.read_digests(spark, path).collect()]
    ids = [x + [1] for x in library_ids(WORDS, [r[1] or "" for r in rows])]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((r[0], len(x), crc(x)) for r, x in zip(rows, ids, strict=True))
    at = 0
    ordered = sorted(got, key=lambda r: r["start"])
    for r in ordered:
        assert r["start"] == at
        at += r["n_tokens"]
    told = [r["doc_id"] for r in ordered if r["doc_id"] is not None]
    assert told == sorted(told)
    shuffled = records.read_shuffled(spark, path, seed=4).collect()
    assert Counter((r.doc_id, bytes(r.ids)) for r in shuffled) == Counter((r[0], np.array(x, "<u4").tobytes()) for r, x in zip(rows, ids, strict=True))
    assert [r.doc_id for r in shuffled] != [r["doc_id"] for r in ordered]


def test_damage_is_found():
    end = bytes([records.END])  # which the text sink writes
    data = records.frame(7, np.arange(5, dtype=np.uint32)) + end + records.frame(None, np.array([70_000, 1], np.uint32)) + end
    assert [(d, x.tolist()) for _, _, d, x in records.frames(data)] == [(7, [0, 1, 2, 3, 4]), (None, [70_000, 1])]
    for at in range(len(data)):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError, match="cut|damaged"):
            list(records.frames(broken))
    with pytest.raises(ValueError, match="cut"):
        list(records.frames(data[:-1]))


def test_empty_records(spark, no_docs, tmp_path):
    path = str(tmp_path / "records")
    records.write_records(no_docs, path, WORDS, end_id=1)
    assert records.read_digests(spark, path).count() == 0


def test_packed_pieces(docs, rows):
    got = packing.packed(docs, BYTES, end_id=2, capacity=1024).collect()
    ids = [x + [2] for x in library_ids(BYTES, [r[1] or "" for r in rows])]
    want = Counter()
    for r, x in zip(rows, ids, strict=True):
        first = len(x) % 1024 or min(len(x), 1024)
        edges = [0, *range(first, len(x) + 1, 1024)]
        for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            want[r[0], i, a, b - a, crc(x[a:b])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= math.ceil(sum(map(len, ids)) / 1024) + 1


def test_packing_nothing(no_docs):
    assert packing.packed(no_docs, BYTES, end_id=2, capacity=1024).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_swaps_keep_pieces_and_never_add_bins(lengths):
    before = packing.best_fit(lengths, 100)
    count = len(before)
    after = packing.improved([list(b) for b in before], lengths, 100)
    assert sorted(i for b in after for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 100 for b in after)
    assert math.ceil(sum(lengths) / 100) <= len(after) <= count


def test_swaps_empty_bins():
    lengths = [4, 4, 4, 3, 3, 3, 3, 3, 3]
    before = packing.best_fit(lengths, 10)
    assert len(before) == 4
    assert len(packing.improved([list(b) for b in before], lengths, 10)) == 3


def has_step(giver, taker, capacity):
    """Whether lengths of giver can move to taker, which is no emptier: one for none, one or two, or two for none or one."""
    room = capacity - sum(taker)
    one, two = [(x,) for x in taker], list(itertools.combinations(taker, 2))
    steps = [(n, t) for n in giver for t in [(), *one, *two]] + [(n + m, t) for n, m in itertools.combinations(giver, 2) for t in [(), *one]]
    return room > 0 and any(0 < n - sum(t) <= room for n, t in steps)


def steps_left(bins, givers, capacity):
    return [(a, b) for a in givers for b in bins if b is not a and sum(a) <= sum(b) and has_step(a, b, capacity)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(20, 60), min_size=10, max_size=60))
def test_swaps_end_where_no_step_is_left(lengths):
    after = packing.improved(packing.best_fit(lengths, 100), lengths, 100)
    bins = [[lengths[i] for i in b] for b in after]
    assert len(bins) == math.ceil(sum(lengths) / 100) or not steps_left(bins, [b for b in bins if sum(b) < 100], 100)


def test_swaps_end_where_no_step_is_left_with_many_underfull_bins():
    lengths = np.random.default_rng(1).integers(300, 501, 8000).tolist()
    after = packing.improved(packing.best_fit(lengths, 1024), lengths, 1024)
    bins = sorted(([lengths[i] for i in b] for b in after), key=sum)
    assert sorted(x for b in bins for x in b) == sorted(lengths)
    assert not steps_left(bins, bins[:20] + bins[len(bins) // 2 : len(bins) // 2 + 20], 1024)


def best_tokens(word, scores, byte):
    """Every way to cut a word, the plain way: (score, tokens) of the best."""
    text = "▁" + word
    table = [(0.0, 0)] + [(-math.inf, 0)] * len(text)
    for end in range(1, len(text) + 1):
        found = []
        for start in range(end):
            piece = text[start:end]
            if piece in scores:
                found.append((table[start][0] + scores[piece], table[start][1] + 1))
        c = text[end - 1]
        if c not in scores:
            size = len(c.encode())
            found.append((table[end - 1][0] + size * byte, table[end - 1][1] + size))
        table[end] = max(found, key=lambda x: (x[0], -x[1]))
    return table[-1][1]


def test_trie_counts(docs, rows):
    trie = token_counts.trie(PIECES)
    want = Counter()
    for doc_id, text, *_ in rows:
        words = token_counts.WORD.findall(text or "")
        counts = {w: best_tokens(w, trie.scores, trie.byte) for w in set(words)}
        want[doc_id, len(words), sum(counts[w] for w in words)] += 1
    got = token_counts.token_counts(docs, PIECES).collect()
    assert Counter(map(tuple, got)) == want


def test_each_prefix_is_scored_once(monkeypatch):
    """Over several batches of words: one step for each distinct prefix; and long words agree with the plain table."""
    trie = token_counts.PieceTrie(token_counts.trie(PIECES).scores)
    steps = []
    plain = token_counts.PieceTrie.step
    monkeypatch.setattr(token_counts.PieceTrie, "step", lambda self, text, end, *rest: steps.append(text[:end]) or plain(self, text, end, *rest))
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abeinrst"), rng.integers(1, 9))) for _ in range(600)]
    for word in words + words[:300]:
        assert trie[word] == trie[word]
    prefixes = {("▁" + w)[:k] for w in words for k in range(1, len(w) + 2)}
    assert len(steps) == len(set(steps))
    assert set(steps) == prefixes
    assert len(trie.best) == len(prefixes) + 1
    assert trie == {w: best_tokens(w, trie.scores, trie.byte) for w in words}
    long = "internationalisation中" * 40
    assert trie.count(long) == best_tokens(long, trie.scores, trie.byte)
    assert len(trie.best) <= len(prefixes) + 1 + token_counts.LONG


def test_full_tries_start_anew(docs, monkeypatch):
    want = Counter(map(tuple, token_counts.token_counts(docs, PIECES).collect()))
    monkeypatch.setattr(token_counts, "KEPT", 50)
    assert Counter(map(tuple, token_counts.token_counts(docs, PIECES).collect())) == want


def test_no_counts(no_docs):
    assert token_counts.token_counts(no_docs, PIECES).count() == 0
