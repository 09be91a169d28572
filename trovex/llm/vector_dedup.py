"""Near-duplicate vectors by product quantisation over inverted lists, with an exact cosine rerank.

Equal vectors are one class, so copies cost one vector.  Coarse centres and the codebooks of residuals are fitted on a
bounded sample; every class is indexed: its list, the codes of its residual in each subspace, and how far the decoded
vector lies from it.  A vector probes the lists whose border with its own list lies within reach of a near duplicate.
Table lookups give its distance to the decoded members of a list, rounded down to 16 bits; those that may be within
reach are compared by cosine in double precision.  How far a near duplicate's difference reaches along a direction is measured: on the
sample's links and on its nearest neighbours within lists, and never taken to be less than that of differences that
point no special way.  Four standard deviations are allowed, at most the whole length of a difference, so vectors in
few directions are searched with exact bounds; nearly all pairs are found, and never a wrong one.

A list is dealt to blocks of members and of probing vectors, so no task holds a whole list.  A task emits counts and
a spanning forest of its links, never all pairs.  A pair whose vectors probe each other's lists is met in one of them.

Vectors of each length link among themselves, by an index of their own, whatever their number.  An index of few vectors
is fitted and searched within one task, so that many lengths need no jobs each; sample, index and search are the same,
and so are the links.  Vectors that are null, empty, zero or hold null or non-finite components
link with nothing.  Repeated rows with one vec_id are copies of each other.  Null vec_ids are ignored.  A vector as near
to two lists has the first as its own.  Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovex.llm.common import BATCH_ROWS, binaries, drawn, longs, mapped, stored
from trovex.llm.components import components, forest

#: Vectors for each list, about; fewest and most lists; rows of the sample that centres and codebooks are fitted on.
LIST, LEAST_LISTS, MOST_LISTS, SAMPLE = 2000, 16, 4096, 65_536
SUBSPACES, CODES, ROUNDS, SEED = 8, 256, 8, 11
#: Differences of the sample that tell how far near duplicates reach, and how many standard deviations count.
DIFFERENCES, DEVIATIONS = 256, 4.0
#: Components of all vectors of one length, at most SAMPLE of them, up to which one task fits and searches their index.
DIRECT = 1 << 21
#: Members and probing vectors of one task.
BLOCK, PROBING = 4096, 16_384


def centres(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's algorithm."""
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        at = nearest(x, c)
        n = np.bincount(at, minlength=k)
        some, begins = n > 0, np.cumsum(n) - n
        c[some] = np.add.reduceat(x[np.argsort(at, kind="stable")], begins[some]) / n[some, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    x, c = x.astype(np.float32), c.astype(np.float32)
    half, out = (c * c).sum(1) / 2, np.empty(len(x), np.int64)
    for s in range(0, len(x), 1024):
        far = x[s : s + 1024] @ c.T
        np.subtract(half, far, out=far).argmin(axis=1, out=out[s : s + 1024])
    return out


@dataclass
class Index:
    lists: np.ndarray  # centres of the lists
    books: np.ndarray  # subspace, code, component
    apart: float  # the largest distance of linked unit vectors
    differences: list[np.ndarray]  # samples of differences of near vectors, of length apart

    def residual_codes(self, residual: np.ndarray) -> np.ndarray:
        m, _, w = self.books.shape
        return np.stack([nearest(residual[:, i * w : (i + 1) * w], self.books[i]) for i in range(m)], axis=1).astype(np.uint8)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.books[i][codes[:, i]] for i in range(len(self.books))], axis=1)

    def reach(self, squared: np.ndarray, moments: list[np.ndarray], width: int) -> np.ndarray:
        """How far along vectors of such squared lengths a difference reaches, times their lengths; moments: the mean squares of the samples' products with them."""
        most = np.maximum.reduce([squared * (self.apart**2 / width), *moments])
        return np.minimum(self.apart * np.sqrt(squared), DEVIATIONS * np.sqrt(most))

    def probes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's list, and for each vector and list whether it probes it."""
        c = self.lists
        far = (c * c).sum(1) / 2 - x @ c.T
        home = far.argmin(1)

        def apart(v: np.ndarray) -> np.ndarray:  # squared distances of the lists' v from those of home
            own = (v * v).sum(1)
            return np.maximum(own[home][:, None] + own - 2 * v[home] @ v.T, 1e-30)

        border = self.reach(apart(c), [apart(c @ d.T) / len(d) for d in self.differences], x.shape[1])
        return home, far - far[np.arange(len(x)), home][:, None] <= border

    def limit(self, error: np.ndarray) -> np.ndarray:
        """The largest squared distance from a probing vector to a member's decoded vector, which is off by error, where they may link."""
        squared = (error * error).sum(1)
        along = self.reach(squared, [((error @ d.T) ** 2).mean(1) for d in self.differences], error.shape[1])
        return self.apart**2 + squared + 2 * along + 1e-4  # for rounding

    def placed(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """Home, probed lists, codes and limit of each unit vector."""
        home, probed = self.probes(x)
        residual = x - self.lists[home]
        codes = self.residual_codes(residual)
        return home.astype(np.int32), [np.flatnonzero(p).astype(np.int32) for p in probed], codes, self.limit(residual - self.decoded(codes))


def neighbours(sample: np.ndarray, home: np.ndarray, apart: float, rng: np.random.Generator) -> list[np.ndarray]:
    """Differences from the nearest other vector of the list, and those of them that link, stretched to length apart."""
    near, linked = [], []
    for i in rng.permutation(len(sample))[: 8 * DIFFERENCES]:
        own = np.flatnonzero(home == home[i])
        far = 2 - 2 * sample[own] @ sample[i]
        far[own == i] = np.inf
        if len(own) < 2:
            continue
        d = sample[own[far.argmin()]] - sample[i]
        length = np.linalg.norm(d)
        if length > 1e-6:
            (linked if length <= apart else near).append(d * (apart / length))
    return [np.stack(x[:DIFFERENCES]) for x in (near, linked) if len(x) >= 16]


def fitted(sample: np.ndarray, n: int, cosine: float) -> Index:
    """The index of n vectors, from a sample of them."""
    rng = np.random.default_rng(SEED)
    coarse = centres(sample, min(MOST_LISTS, max(LEAST_LISTS, n // LIST)), rng)
    home = nearest(sample, coarse)
    residual = sample - coarse[home]
    m = math.gcd(SUBSPACES, sample.shape[1])
    books = [centres(part, CODES, rng) for part in np.split(residual, m, axis=1)]
    apart = math.sqrt(2 - 2 * cosine)
    return Index(coarse, np.stack(books), apart, neighbours(sample, home, apart, rng))


def unit_rows(vectors: Sequence[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])  # by a power of two, so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1)[:, None]


def valid(vectors: DataFrame) -> DataFrame:
    """(embedding, vec_id, size) of each distinct usable vector: its smallest vec_id and how many share it."""
    v = F.col("embedding").cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), v.alias("embedding")).where(F.col("vec_id").isNotNull() & sound)
    return rows.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("size"))


def packed(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = [np.asarray(x, np.float64) for x in batch.column("embedding").to_pylist()]
    return pa.record_batch([batch.column("vec_id"), batch.column("size"), longs([len(x) for x in rows]), binaries([x.tobytes() for x in rows])], ["vec_id", "size", "width", "vector"])


def indexed(classes: DataFrame, index: Index) -> DataFrame:
    """Adds home, probes, codes and limit to each class."""

    def index_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        home, probes, codes, limit = index.placed(unit_rows(batch.column("vector").to_pylist()))
        extra = [pa.array(home), pa.array(probes, pa.list_(pa.int32())), binaries([c.tobytes() for c in codes]), pa.array(limit)]
        return pa.record_batch([*batch.columns, *extra], [*batch.schema.names, "home", "probes", "codes", "limit"])

    return mapped(classes, index_batch, "vec_id long, size long, width long, vector binary, home int, probes array<int>, codes binary, limit double")


def links_of(members: pd.DataFrame, probing: pd.DataFrame, at: int, index: Index, cosine: float) -> pd.DataFrame:
    """Counts (a, n) and forest edges (a, b) of the links between members of a list and vectors that probe it."""
    base = unit_rows(members["vector"])
    codes = np.frombuffer(b"".join(members["codes"]), np.uint8).reshape(len(members), -1).T.astype(np.intp)
    ids, sizes = members["vec_id"].to_numpy(), members["size"].to_numpy()
    probed = np.zeros((len(members), len(index.lists)), bool)
    for i, p in enumerate(members["probes"]):
        probed[i, p] = True
    m, _, w = index.books.shape
    cap = 65_535 // m - 1  # m rounded distances, none above cap, add up in 16 bits
    scale = (cap - m - 1) / members["limit"].max()
    limit = (members["limit"].to_numpy() * scale + m).astype(np.uint16)[:, None]  # m: single precision may round up
    books = np.concatenate([-2 * index.books, (index.books**2).sum(2)[:, :, None], np.ones((m, index.books.shape[1], 1))], axis=2)
    books = (books * scale).astype(np.float32)
    count = {"a": [], "b": [], "n": []}
    got = np.zeros(len(members), np.int64)
    for s in range(0, len(probing), 256):
        part = probing.iloc[s : s + 256]
        q = unit_rows(part["vector"])
        home, own = part["home"].to_numpy(), part["vec_id"].to_numpy()
        ahead = q - index.lists[at]
        far = np.zeros((len(base), len(q)), np.uint16)
        step = np.empty_like(far)
        for i in range(m):
            x = ahead[:, i * w : (i + 1) * w]
            x = np.column_stack([x, np.ones(len(x)), (x * x).sum(1)]).astype(np.float32)
            table = books[i] @ x.T  # squared distances of codes and probing vectors
            table = np.clip(table, 0, cap, out=table).astype(np.uint16)
            far += np.take(table, codes[i], axis=0, out=step, mode="clip")  # a row of the table for each member: its distances to all probing vectors
        j, i = np.divmod(np.flatnonzero(far <= limit), len(q))
        # at home each pair counts once; a pair that meets in both lists counts in the lower
        once = np.where(home[i] == at, own[i] < ids[j], ~(probed[j, home[i]] & (home[i] < at)))
        i, j = i[once], j[once]
        if not len(i):
            continue
        same = np.empty(len(i), bool)
        for k in range(0, len(i), 65_536):
            same[k : k + 65_536] = np.einsum("ij,ij->i", q[i[k : k + 65_536]], base[j[k : k + 65_536]]) >= cosine
        i, j = i[same], j[same]
        if not len(i):
            continue
        got += np.bincount(j, part["size"].to_numpy()[i], len(members)).astype(np.int64)
        gave = np.bincount(i, sizes[j], len(q)).astype(np.int64)
        some = np.flatnonzero(gave)
        count["a"] += own[some].tolist()
        count["b"] += [None] * len(some)
        count["n"] += gave[some].tolist()
        linked = np.zeros((len(q), len(base)), bool)
        linked[i, j] = True
        left, right = forest(linked)
        count["a"] += own[left].tolist()
        count["b"] += ids[right].tolist()
        count["n"] += [0] * len(left)
    some = np.flatnonzero(got)
    count["a"] += ids[some].tolist()
    count["b"] += [None] * len(some)
    count["n"] += got[some].tolist()
    return pd.DataFrame({"a": pd.array(count["a"], "Int64"), "b": pd.array(count["b"], "Int64"), "n": pd.array(count["n"], "Int64")})


def found(items: DataFrame, index: Index, cosine: float) -> DataFrame:
    """(a, b, n) of all tasks, from the stored index."""
    members = items.groupBy("home").agg(F.count(F.lit(1)).alias("members"))
    probing = items.select(F.explode("probes").alias("home")).groupBy("home").agg(F.count(F.lit(1)).alias("probing"))
    parts = members.join(probing, "home").select(F.col("home").alias("list"), F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("probing") / PROBING).cast("int").alias("turns"))
    parts = F.broadcast(parts)  # a row for each list, MOST_LISTS at most
    place = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stays = items.withColumn("list", F.col("home")).join(parts, "list").withColumn("block", place("blocks", "block")).withColumn("turn", every("turns")).withColumn("member", F.lit(True))
    comes = items.withColumn("list", F.explode("probes")).join(parts, "list").withColumn("turn", place("turns", "turn")).withColumn("block", every("blocks")).withColumn("member", F.lit(False))
    comes = comes.withColumn("probes", F.lit(None).cast("array<int>")).withColumn("codes", F.lit(None).cast("binary"))
    columns = ["list", "block", "turn", "member", "vec_id", "size", "width", "vector", "home", "probes", "codes", "limit"]

    def task(rows: pd.DataFrame) -> pd.DataFrame:
        here = rows["member"].to_numpy()
        if not here.any():
            return pd.DataFrame({"a": [], "b": [], "n": []})
        return links_of(rows[here], rows[~here].reset_index(drop=True), int(rows["list"].iat[0]), index, cosine)

    return stays.select(columns).union(comes.select(columns)).groupBy("list", "block", "turn").applyInPandas(task, "a long, b long, n long")


def in_one_task(rows: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """(a, b, n) of vectors of one length, from an index that is fitted and searched here."""
    rows = rows.sort_values(["rank", "vec_id"], ignore_index=True)
    x = unit_rows(rows["vector"])
    index = fitted(x[:SAMPLE], len(x), cosine)
    home, probes, codes, limit = zip(*[index.placed(x[s : s + BATCH_ROWS]) for s in range(0, len(x), BATCH_ROWS)], strict=True)
    probes = [p for part in probes for p in part]
    rows = rows.assign(home=np.concatenate(home), probes=probes, codes=[c.tobytes() for part in codes for c in part], limit=np.concatenate(limit))
    at, own = np.concatenate(probes), np.repeat(np.arange(len(rows)), [len(p) for p in probes])
    found = []
    for k, members in rows.groupby("home"):
        probing = rows.iloc[own[at == k]].reset_index(drop=True)
        found += [links_of(members.iloc[s : s + BLOCK], probing, int(k), index, cosine) for s in range(0, len(members), BLOCK)]
    return pd.concat(found)


def links(classes: DataFrame, cosine: float) -> DataFrame:
    """Stored (a, b, n) of the links of stored classes, length by length."""
    lengths = classes.groupBy("width").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy("width").collect()  # lengths, not vectors
    large = [(r.width, r.n) for r in lengths if r.width * r.n > DIRECT or r.n > SAMPLE]
    few = classes.where(~F.col("width").isin([w for w, _ in large])) if large else classes
    rank = F.xxhash64(F.lit(SEED), "vec_id")
    rows = few.withColumn("rank", rank).groupBy("width").applyInPandas(lambda rows: in_one_task(rows, cosine), "a long, b long, n long")
    for width, n in large:
        own = classes.where(F.col("width") == width)
        draw = drawn(own, SAMPLE, rank, "vec_id").select("vector").collect()
        index = fitted(unit_rows([x[0] for x in draw]), n, cosine)
        rows = rows.union(found(stored(indexed(own, index), "index"), index, cosine))
    return stored(rows, "links")


def linked(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    whole = stored(valid(vectors), "vectors")
    classes = stored(mapped(whole, packed, "vec_id long, size long, width long, vector binary"), "classes")
    everyone = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = links(classes, cosine)
    counts = rows.where("b is null").groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("n"))
    labels = components(rows.where("b is not null").select("a", "b").distinct())
    named = classes.join(counts, "vec_id", "left").join(labels.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    named = named.select(F.col("vec_id").alias("class"), (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("label", "vec_id").alias("component_id"))
    copies = whole.where("size > 1").select("embedding", F.col("vec_id").alias("class"))
    own = everyone.join(copies, "embedding", "left").select("vec_id", F.coalesce("class", "vec_id").alias("class"))
    out = own.join(named, "class", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
