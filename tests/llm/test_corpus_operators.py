"""Quality rules, the language model, revisits, shards, the mix and the pipeline."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import tracemalloc
import zlib
from collections import Counter, defaultdict
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from trovex.llm import hmm, mixing, quality, records, revisits, sharding
from trovex.llm.common import drawn, numbered

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_statistics(text):
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_quality_statistics(docs, rows, labels):
    got = quality.judged(docs, labels).collect()
    want = Counter((r[0], *plain_statistics(r[1] or "")) for r in rows)
    names = ["doc_id", *quality.STATISTICS[:5]]
    assert Counter(tuple(r[n] for n in names) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_filtered_agrees_with_judged(docs, labels):
    kept = Counter(r.doc_id for r in quality.judged(docs, labels).collect() if r.kept)
    out = quality.filtered(docs, labels)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == kept


def test_quality_without_labels(spark, docs, no_docs, labels):
    none = labels.limit(0)
    assert all(r.kept != r.base_failed for r in quality.judged(docs, none).collect())
    assert quality.judged(no_docs, labels).count() == 0
    assert quality.filtered(no_docs, labels).count() == 0


def test_forest_tells_odd_documents(spark, sf_dir):
    """On labelled rows that neither trees nor threshold saw, nearly all bad ones go and nearly all good ones stay."""
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.quality: (r.kept, r.n) for r in quality.held_out_shares(docs, labels).collect()}
    assert kept[1][1] > 500
    assert kept[0][1] > 30
    assert kept[1][0] >= 0.98
    assert kept[0][0] <= 0.1


def plain_path(x, rows, tree, node=0):
    """Splits from the root to the leaf of x, and what the leaf's rows would add."""
    if not tree.below[node]:
        n = len(rows)
        more = 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
        return more
    f, s = tree.feature[node], tree.split[node]
    side = x[f] >= s
    return 1 + plain_path(x, [r for r in rows if (r[f] >= s) == side], tree, tree.below[node] + int(side))


def test_path_lengths():
    """Against a walk that carries the sample's rows along; trees are as deep as the logarithm of their sample at most."""
    rng = np.random.default_rng(2)
    sample = np.round(rng.normal(size=(64, 4)), 1)  # with ties
    tree = quality.grown(sample, np.random.default_rng(3))
    x = np.concatenate([sample, rng.normal(size=(50, 4)) * 3])
    assert tree.paths(x) == pytest.approx([plain_path(row, list(sample), tree) for row in x])
    assert tree.paths(np.array([[50.0] * 4])) < np.median(tree.paths(sample))
    assert quality.grown(np.zeros((8, 4)), rng).paths(np.zeros((3, 4))) == pytest.approx([quality.added(8)] * 3)


def test_threshold_is_the_best():
    """Against trying every bin."""
    rng = np.random.default_rng(4)
    for shift in (0, 300, 900):
        good, bad = (np.clip(rng.normal(m, 150, 400), 0, quality.BINS - 1).astype(int) for m in (700, 700 + shift))
        counts = np.stack([np.bincount(bad, minlength=quality.BINS), np.bincount(good, minlength=quality.BINS)]).astype(float)
        gains = {b: (bad >= b).mean() - quality.COST * (good >= b).mean() for b in range(quality.BINS) if (good >= b).mean() <= quality.FALSE_SHARE}
        at = quality.threshold(counts)
        if max(gains.values()) <= 0:
            assert at == math.inf
        else:
            cut = min(b for b in gains if b / quality.BINS > at)
            assert gains[cut] == pytest.approx(max(gains.values()))
    assert quality.threshold(np.zeros((2, quality.BINS))) == math.inf


def test_verdicts_come_from_scores(docs, labels):
    """The forest's scores, computed the plain way from whole texts, on either side of one threshold."""
    forest = quality.fitted(quality.labelled(quality.stored(quality.measured(docs), "statistics"), labels))
    for r in quality.judged(docs, labels).collect():
        assert r.kept == (not r.base_failed and r.score <= forest.threshold)


def test_bounded_draw(spark):
    df = spark.range(5000).withColumn("x", F.col("id") * 2)
    want = [r.id for r in df.orderBy(F.xxhash64("id"), "id").limit(50).collect()]
    assert [r.id for r in drawn(df, 50, F.xxhash64("id"), "id").collect()] == want
    assert drawn(df.limit(0), 50, F.xxhash64("id")).count() == 0
    assert drawn(df.limit(30), 50, F.xxhash64("id")).count() == 30


def test_words_of_bytes():
    """Words from UTF-8 bytes part at ASCII white space alone, and A-Z alone are lower-cased; a word's class is by its last three letters."""
    texts = ["a\x1cb\x85C\xa0d \x0b\x0c\r\n\tE", "ÀÉ İ K ẞ ABCdef", "x　y\u2028Z \x00Q", "", None, " \n\t ", "日本語テキスト abcDEF"]
    lowered = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x or "") for x in texts]
    assert [[w.decode() for w in words] for words in hmm.words_of(pa.array(texts))] == [WORD.findall(x) for x in lowered]
    words = ["日本語", "x日本語", "ab", "cab", "", "éab"]
    got = hmm.hashes_of([w.encode() for w in words]) % hmm.BUCKETS
    assert got.tolist() == [zlib.crc32(w[-3:].encode()) % hmm.BUCKETS for w in words]


def test_language_model_base(docs, rows):
    got = hmm.scored(docs).collect()
    fold = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    tokens = [[*WORD.findall(lower(r[1])), ""] for r in rows]
    counts = Counter(t for r, own in zip(rows, tokens, strict=True) if fold(r[0]) != 2 for t in own)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(r[0]), fold(r[0]) == 2, len(own), sum(counts[t] > 0 for t in own), n, round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own), 4)) for r, own in zip(rows, tokens, strict=True))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_language_model_beats_the_base(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    row = hmm.scored(docs).where("held_out").agg(F.sum("base_score").alias("base"), F.sum("score").alias("score"), F.count(F.lit(1)).alias("n")).first()
    assert row.n > 50
    assert row.score > row.base


def test_language_model_learns_from_long_texts(spark):
    """Two kinds of texts with words of their own, all long: states that know the kind halve the choice of words."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"{'ab'[i % 2]}{w}" for w in rng.integers(100, size=2500)) for i in range(40)]
    got = hmm.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("held_out").collect()
    assert got
    assert all(r.score > r.base_score + 0.2 * r.n_tokens for r in got)


def test_language_model_starts_with_different_states():
    unigram = np.full(hmm.OWN + hmm.BUCKETS, 1 / (hmm.OWN + hmm.BUCKETS))
    for n in (0.0, 1e12):  # no texts, and so many that hashing deals every state the same
        emit = hmm.started(np.full((len(unigram), hmm.STATES), n), unigram).emit
        assert all(abs(emit[:, a] - emit[:, b]).sum() > 0.1 for a in range(hmm.STATES) for b in range(a))


def test_forward_is_exact():
    """The scaled recursion against the sum over all paths, and Baum-Welch never lowers the likelihood."""
    rng = np.random.default_rng(0)
    random = lambda *s: (lambda x: x / x.sum(-1, keepdims=True))(rng.random(s))
    emit = np.zeros((hmm.OWN + hmm.BUCKETS, hmm.STATES))
    emit[:5] = random(hmm.STATES, 5).T
    model = hmm.Model(random(hmm.STATES), random(hmm.STATES, hmm.STATES), emit)
    texts = [np.array(x) for x in ([0, 1, 2, 3], [4, 4], [2])]

    def plain(x):
        a = model.start * emit[x[0]]
        for c in x[1:]:
            a = (a @ model.move) * emit[c]
        return a.sum()

    classes, begins, live = hmm.by_time(texts)
    scale = hmm.forward(model, emit[classes], begins, live)
    whose = np.arange(len(scale)) - np.repeat(begins[:-1], live)
    assert np.bincount(whose, np.log10(scale), 3) == pytest.approx([math.log10(plain(x)) for x in texts])

    def likelihood(m):
        return np.log(hmm.forward(m, m.emit[classes], begins, live)).sum()

    before = likelihood(model)
    for _ in range(5):
        sums = hmm.Sums.zero()
        hmm.posterior(model, texts, sums)
        assert sums.emit.sum() == pytest.approx(7)
        assert sums.start.sum() == pytest.approx(3)
        model = hmm.Model(sums.start / sums.start.sum(), sums.move / np.maximum(sums.move.sum(1, keepdims=True), 1e-300), sums.emit / np.maximum(sums.emit.sum(0), 1e-300))
        after = likelihood(model)
        assert after >= before - 1e-6
        before = after


def plain_counts(model, texts):
    """Expected counts by forward and backward probabilities of each text, without scaling."""
    sums = hmm.Sums.zero()
    for x in texts:
        a = [model.start * model.emit[x[0]]]
        for c in x[1:]:
            a.append((a[-1] @ model.move) * model.emit[c])
        b = [np.ones(hmm.STATES)]
        for c in x[:0:-1]:
            b.insert(0, model.move @ (model.emit[c] * b[0]))
        total = a[-1].sum()
        sums.log += math.log(total)
        for t, c in enumerate(x):
            sums.emit[c] += a[t] * b[t] / total
            if t:
                sums.move += np.outer(a[t - 1], model.emit[c] * b[t]) * model.move / total
        sums.start += a[0] * b[0] / total
    return sums


def same_counts(got, want):
    assert got.log == pytest.approx(want.log, rel=1e-5)
    assert got.start == pytest.approx(want.start, rel=1e-4, abs=1e-4)
    assert got.move == pytest.approx(want.move, rel=1e-4, abs=1e-3)
    assert got.emit == pytest.approx(want.emit, rel=1e-4, abs=1e-3)


def test_counts_of_many_partitions_are_plain_baum_welch(spark):
    """Counts summed over the tasks of seven partitions, against one plain run over all texts."""
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 30, n) for n in [*rng.integers(1, 40, 60), 1, 2, 3, 4, 5, 8, 9, 40, 40]]
    emit = np.zeros((hmm.OWN + hmm.BUCKETS, hmm.STATES))
    emit[:30] = rng.dirichlet(np.full(30, 0.2), hmm.STATES).T + 1e-6
    model = hmm.Model(rng.dirichlet(np.ones(hmm.STATES)), rng.dirichlet(np.ones(hmm.STATES), hmm.STATES), emit)
    want = plain_counts(model, texts)
    rows = [(i, bytearray(x.astype("<u2").tobytes())) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "row long, classes binary").repartition(7)
    same_counts(hmm.expected(df, spark.sparkContext.broadcast(model)), want)
    one = hmm.Sums.zero()
    hmm.posterior(model, sorted(texts, key=lambda x: -len(x)), one)
    same_counts(one, want)


def test_no_language(no_docs):
    assert hmm.scored(no_docs).count() == 0


def test_revisits_against_sql(spark, sf_dir, duck):
    from trovex.llm.queries import QUERIES

    df = QUERIES["op5_revisits"](spark, sf_dir)
    found = duck.execute(revisits.SQL)
    columns = [c[0] for c in found.description]
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(found.fetchall())


def test_revisit_cases(spark):
    url = "http://a.example/x"
    rows = [
        (1, url, 10, "response", {"etag": '"1"', "content-type": "text/html", "date": "d1"}, "h1"),
        (2, "https://www.A.example:443/x/?utm_a=1#f", 20, "revisit", {"etag": 'W/"1"', "date": "d2", "content-length": "0"}, None),
        (3, url, 30, "response", {"etag": '"3"'}, "h3"),
        (4, url, 40, "revisit", {"etag": '"1"'}, None),
        (5, url, 40, "revisit", None, "h3"),
        (6, url, 5, "revisit", {"etag": '"1"'}, None),
        (7, None, 50, "revisit", None, None),
        (8, url, None, "revisit", None, None),
        (9, url, 50, "revisit", {}, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, headers map<string,string>, digest string").withColumn("state", F.lit("x"))
    got = {r.record_id: (r.state, r.refers_to, r.headers) for r in revisits.resolved(df).collect()}
    assert got[2] == ("resolved", 1, {"etag": 'W/"1"', "content-type": "text/html", "date": "d2"})
    assert [(k, *got[k][:2]) for k in sorted(got)] == [(2, "resolved", 1), (4, "mismatch", 3), (5, "resolved", 3), (6, "orphan", None), (7, "orphan", None), (8, "orphan", None), (9, "unchecked", 3)]
    assert revisits.resolved(df.limit(0)).count() == 0


def plain_state(rows, r):
    """The latest earlier response of the same url in a plain walk, and what its validators say."""
    full = max(((x[2], x[0], x) for x in rows if x[3] == "response" and x[1] == r[1] and (x[2], x[0]) < (r[2], r[0])), default=None)
    if full is None:
        return "orphan", None
    a, b = r[4] or {}, full[2][4] or {}
    for x, y in ((a.get("etag"), b.get("etag")), (a.get("last-modified"), b.get("last-modified")), (r[5], full[2][5])):
        if x is not None and y is not None:
            return "resolved" if x == y else "mismatch", full[1]
    return "unchecked", full[1]


def test_bursts_are_cut(spark, monkeypatch):
    """Half of all records are one url in one second, one ts lies far off; every kind of state occurs."""
    monkeypatch.setattr(revisits, "PART", 50)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        url, ts = ("a.example/x", 1000) if i % 2 else (f"b.example/{i % 7}", int(rng.integers(0, 2000)))
        headers = {} if rng.random() < 0.3 else {"etag": str(rng.integers(3))} if rng.random() < 0.7 else {"last-modified": str(rng.integers(2))}
        rows.append((i, url, ts, "response" if rng.random() < 0.4 else "revisit", headers, None if rng.random() < 0.5 else f"h{rng.integers(3)}"))
    rows.append((600, "a.example/x", 10**15, "revisit", {}, None))
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, headers map<string,string>, digest string")
    got = {r.record_id: (r.state, r.refers_to) for r in revisits.resolved(df).collect()}
    want = {r[0]: plain_state(rows, r) for r in rows if r[3] == "revisit"}
    assert got == want
    assert {s for s, _ in want.values()} == {"orphan", "resolved", "mismatch", "unchecked"}


def test_shards(docs, rows, no_docs):
    got = sharding.sharded(docs, sharding.even_tree(24), sharding.even_tree(25)).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots, where = defaultdict(list), {}
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24)
        assert where.setdefault(r.doc_id, r.shard) == r.shard
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sharding.sharded(no_docs, sharding.even_tree(24), sharding.even_tree(25)).count() == 0


def test_weights_move_only_their_subtree(spark):
    leaves = sharding.even_tree(24)
    heavier = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in leaves]
    df = spark.range(20_000).select(sharding.descend(F.col("id"), leaves).alias("a"), sharding.descend(F.col("id"), heavier).alias("b"))
    rows = df.groupBy("a", "b").count().collect()
    share = sum(r["count"] for r in rows if r.a == 5) / 20_000
    assert 0.03 < share < 0.054
    for r in rows:
        if r.a != r.b and r.b != 5:
            # only between racks and shards on the way to the one that gained
            assert leaves[r.b].rack == leaves[5].rack or leaves[r.b].region == leaves[5].region


def plain_targets(sizes, share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: [5.0, 2.0, 1.0][i % 3] for i, s in enumerate(names)}
    left, free, target = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s] + 1e-9]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def test_mix(docs, rows, no_docs):
    got = mixing.mixed(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows)
    target = plain_targets(sizes)
    source_of = {(r[0]): r[3] for r in rows}
    taken = Counter()
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s]
        assert r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 2 * mixing.BLOCK)
    assert Counter(map(tuple, mixing.mixed(docs).collect())) == Counter(map(tuple, got))
    assert mixing.mixed(no_docs).count() == 0


def test_mixed_texts_are_what_is_taken(docs):
    plan = Counter()
    for r in mixing.mixed(docs).collect():
        plan[r.doc_id] += r.taken
    texts = mixing.chosen_texts(docs)
    assert texts.columns == docs.columns
    got = Counter()
    for r in texts.collect():
        got[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert +got == +plan


def test_null_ids_do_not_share_a_shard(spark):
    """Half of all rows have no doc_id."""
    df = spark.createDataFrame([(None if i % 2 else i, f"a{i} b c d e f", "one") for i in range(6000)], "doc_id long, text string, source string")
    sizes = mixing.stored(mixing.sized(df), "sizes")
    counts = [r["count"] for r in mixing.placed(sizes, 1).groupBy("shard").count().collect()]
    assert max(counts) < 1.2 * mixing.SHARD
    assert Counter(map(tuple, mixing.mixed(df).collect())) == Counter(map(tuple, mixing.mixed(df).collect()))


def test_mixed_texts_keep_clashing_columns_and_each_copys_own(spark):
    rows = [(i % 30, "one two three four five", "s", f"own{i}", 1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _mix_hash string, _mix_copies int, text_hash int")
    got = mixing.chosen_texts(df.withColumn("copy", F.lit(5)).withColumn("spans", F.lit(6)))
    assert got.columns == [*df.columns, "copy", "spans"]
    marks = {r._mix_hash for r in got.collect()}
    assert marks <= {f"own{i}" for i in range(60)}
    assert len(marks) > 30  # both copies of a row give words


def test_quotas_are_sainte_lague():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 6))
        votes, most = (rng.random(n) * 20).tolist(), rng.integers(0, 12, n).tolist()
        seats = int(rng.integers(0, 40))
        given = [0] * n
        for _ in range(min(seats, sum(most))):
            best = max((i for i in range(n) if given[i] < most[i]), key=lambda i: votes[i] / (2 * given[i] + 1))
            given[best] += 1
        assert mixing.quotas(votes, seats, most) == given


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in p.STAGES[:-1]:
        began = datetime.now()
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        assert docs.count() > 0.2 * n, (name, began)
    assert len(p.STAGES) == 4
    assert p.run(spark, sf_dir).count() > 0


def test_pipeline_stages_take_odd_rows(spark, docs, no_docs, sf_dir):
    import corpus_pipeline as p

    for _, stage in p.STAGES:
        assert stage(spark, docs, sf_dir).count() > 0
        assert stage(spark, no_docs, sf_dir).count() == 0


def test_a_long_text_among_short_ones_takes_memory_of_its_tokens():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 50, n) for n in (300_000, *[20] * 5000)]
    emit = np.zeros((hmm.OWN + hmm.BUCKETS, hmm.STATES))
    emit[:50] = rng.random((50, hmm.STATES))
    model = hmm.model_of(hmm.Sums(rng.random(hmm.STATES), rng.random((hmm.STATES, hmm.STATES)), emit), np.full(len(emit), 1 / len(emit)))
    whole, parts = hmm.Sums.zero(), hmm.Sums.zero()
    tracemalloc.start()
    hmm.posterior(model, texts, whole)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200e6
    hmm.posterior(model, texts[:1], parts)
    hmm.posterior(model, texts[1:], parts)
    assert whole.log == pytest.approx(parts.log, rel=1e-5)
    assert whole.move == pytest.approx(parts.move, rel=1e-3) and whole.emit == pytest.approx(parts.emit, rel=1e-3, abs=1e-2)


def test_many_small_sources_meet_their_targets(spark):
    """300 sources of one block a shard or less: what each takes is within one block of its target, or 5 percent."""
    rows = [(i, " ".join(["w"] * 60), f"s{i % 300:03}") for i in range(30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    goal, took = {}, Counter()
    source = {r[0]: r[2] for r in rows}
    for r in mixing.mixed(df).collect():
        goal[source[r.doc_id]] = r.target
        took[source[r.doc_id]] += r.taken
        assert r.taken <= 2 * r.size
    assert max(abs(took[s] - t) / t for s, t in goal.items()) < 0.05


def test_equal_rows_are_dealt_to_many_buckets(spark, monkeypatch):
    """Half of all rows are one row: no bucket of the numbering and no range of records holds most of them."""
    rows = spark.range(4000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("doc_id"), F.lit(1).alias("g"))
    seen = numbered(rows.repartition(4), ["g"], [F.col("doc_id")], "n", rows_each=250, at_least=16)
    assert sorted(r.n for r in seen.collect()) == list(range(4000))
    monkeypatch.setattr(records, "FILE_BYTES", 4000)
    docs = rows.select("doc_id", F.lit("some words that repeat").alias("text")).repartition(4)
    sizes = [r.n for r in records.encoded_frames(docs, "word_bpe_49k.json", 1).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) > 15 and max(sizes) < 2.5 * 4000 / len(sizes)


def plain_draw(*parts):
    """A draw in (0, 1) of Spark's xxhash64: each part is hashed with the hash before as its seed."""
    h = 42
    for p in parts:
        if p is not None:
            h = xxhash.xxh64_intdigest(struct.pack("<q", p) if isinstance(p, int) else p.encode(), seed=h)
    return ((h >> 11) + 0.5) / (1 << 53)


def plain_descend(key, leaves):
    """The child with the least exponential draw at each level of region, rack and shard."""
    node, names = "", {f"{x.region}/{x.rack}/{x.shard}": x.shard for x in leaves}
    for path in (lambda x: x.region, lambda x: f"{x.region}/{x.rack}", lambda x: f"{x.region}/{x.rack}/{x.shard}"):
        weights = Counter()
        for x in leaves:
            if path(x).startswith(node):
                weights[path(x)] += x.weight
        node = min((-math.log(plain_draw(key, c)) / w, c) for c, w in weights.items() if w)[1] + "/"
    return names[node[:-1]]


@pytest.mark.parametrize("count", [24, 25])
def test_draws_are_those_of_a_plain_descent(spark, count):
    tree = sharding.even_tree(count)
    tree[3] = sharding.Leaf(tree[3].region, tree[3].rack, 3, 2.5)
    tree[7] = sharding.Leaf(tree[7].region, tree[7].rack, 7, 0.0)
    keys = spark.createDataFrame([(None,), *[(i,) for i in range(-200, 200)]], "doc_id long")
    got = {r.doc_id: r.shard for r in keys.select("doc_id", sharding.descend(F.col("doc_id"), tree).alias("shard")).collect()}
    assert got == {k: plain_descend(k, tree) for k in got}
    assert 7 not in got.values()


def test_blocks_of_the_mix_are_those_of_a_plain_choice(spark):
    """Quotas met with whole passes and the blocks of least seeded hashes; the words of each block counted one by one."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 700))), f"s{rng.integers(3)}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = mixing.stored(mixing.sized(df), "sizes")
    place = mixing.stored(mixing.placed(sizes, 1), "places")
    stream = mixing.stored(mixing.streams(place, mixing.targets(sizes, [5.0, 2.0, 1.0], 1.5)), "streams")
    taken = Counter()
    by_stream = defaultdict(list)
    for p in place.collect():
        by_stream[p.source, p.shard].append(p)
    for s in stream.collect():
        rank = lambda b, s=s: (int(hashlib.md5(f"{s.source}|{s.shard}|{b}|block1".encode()).hexdigest()[:8], 16), b)
        first = sorted(range(s.blocks), key=rank)[: s.quota % s.blocks]
        for p in by_stream[s.source, s.shard]:
            for word in range(p.start, p.end):
                block = next(b for b in range(s.blocks) if b * s.length // s.blocks <= word < (b + 1) * s.length // s.blocks)
                taken[p.doc_id] += s.quota // s.blocks + (block in first)
    assert {r.doc_id: r.taken for r in mixing.mixed(df).collect()} == {r[0]: taken[r[0]] for r in rows}
