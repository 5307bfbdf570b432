"""MinHash near-duplicate detection with an LSH forest.

A document is the set of its distinct word shingles (ASCII letters lower-cased), and has ``TREES`` labels: the MinHash
values of its set, each tree starting at other values. In a tree the labels are sorted; documents next to each other in
that order are candidates as far as their longest common prefix is ``DEPTH`` values or more. Sorting beyond that prefix
orders crowded regions by longer prefixes, so that the neighbours there are those with the most values in common.

Documents with equal sets are joined first, by a 128-bit fingerprint, and stand for one. Then each document is verified on
the full sets against its best smaller neighbour, that is a forest with one pair per document, and takes the root that it
leads to. After that every region (equal labels up to ``DEPTH`` in some tree) that still holds several roots has all its
remaining pairs between them looked at, in one task: those whose whole signatures agree in fewer values than six standard
deviations below the threshold are ruled out, the others are compared on the full sets. So neither neighbours nor
candidates are capped, and what leaves a region are the links that join its components, no more than it has rows. Large
regions are cut into parts that meet two by two.
A pair at the threshold 0.8 shares a region in some tree with probability 1 - (1 - 0.8^5)^32 = 0.999997.

Defined cases: a text with fewer words than a shingle is one shingle; null and wordless texts have an empty set and link
with nothing, as does a row with null doc_id (its component is null and it is kept); rows that repeat a doc_id are one
document with several sets; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_batches, durable, free_name, give_back, mix, shuffle_partitions, window_hashes, words_of
from .components import components

TREES, DEPTH, NEIGHBOURS, REGION_ROWS = 32, 5, 3, 2048
#: Of a shingle's hash, where sets of a region are compared; links found are confirmed on whole hashes.
SET_BYTES = 5
#: Up to so many candidate documents their ids are broadcast to fetch their texts; beyond, texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_rng = np.random.default_rng(99)
_A = _rng.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64)


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, first, *_ = words_of(texts, lower=True)
    all_windows = window_hashes(words, width)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(all_windows[a : b - width + 1]))
        else:
            out.append(window_hashes(words[a:b], b - a) if b > a else np.empty(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(len(_A), np.uint64(0xFFFFFFFFFFFFFFFF))
    for lo in range(0, len(shingles), 4096):
        part = shingles[lo : lo + 4096]
        np.minimum(out, ((part[None, :] ^ _B[:, None]) * _A[:, None]).min(axis=1), out=out)
    return out


def labels(signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(region key, order beyond the region) for each document and tree, as signed 64-bit values."""
    values = mix(signatures)
    by_tree = values.reshape(len(values), TREES, DEPTH)
    key = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), by_tree.shape[:2]).copy()
    code = np.zeros_like(key)
    for k in range(DEPTH):
        key = mix(key ^ by_tree[:, :, k])
        code = (code << np.uint64(12)) | (np.roll(by_tree[:, :, k], -1, axis=1) & np.uint64(0xFFF))
    return key.view(np.int64), code.view(np.int64)


def describe(docs: DataFrame, width: int) -> DataFrame:
    """(id, n, f1, f2, labels) for each row with doc_id: set size, set fingerprint, packed labels."""

    def run(batches):
        for batch, texts in byte_batches(batches, "text"):
            sets = shingle_sets(texts, width)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            key, code = labels(np.stack([signature(s) for s in sets]))
            packed = np.concatenate([key, code], axis=1)
            f1, f2 = (np.array([int(np.sum(mix(s ^ np.uint64(c)), dtype=np.uint64)) for s in sets], dtype=np.uint64).view(np.int64) for c in (0x1234567, 0x89ABCDE))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(f1), pa.array(f2), pa.array([p.tobytes() if k else None for p, k in zip(packed, n.tolist(), strict=True)], pa.binary())], names=["id", "n", "f1", "f2", "labels"])
        give_back()

    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(run, "id long, n long, f1 long, f2 long, labels binary")


def tree_rows(one_each: DataFrame) -> DataFrame:
    """(key, code, id): a row per document and tree."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                both = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.int64).reshape(part.num_rows, 2, TREES)
                ids = np.repeat(part.column(0).to_numpy(), TREES)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].ravel()), pa.array(both[:, 1].ravel()), pa.array(ids)], names=["key", "code", "id"])

    return one_each.select("id", "labels").mapInArrow(run, "key long, code long, id long")


def neighbours(rows: DataFrame, partitions: int) -> DataFrame:
    """(a, b, hits): pairs a > b of documents near each other in some tree's order, and in how many places.

    The order is cut into ranges. A region that goes over a cut is joined through one document of each range.
    """

    def run(batches):
        tail: np.ndarray | None = None
        ends: dict[int, int] = {}
        for batch in batches:
            now = np.stack([batch.column(0).to_numpy(), batch.column(2).to_numpy()])
            if not now.shape[1]:
                continue
            if tail is None:
                ends[int(now[0, 0])] = int(now[1, 0])
            else:
                now = np.concatenate([tail, now], axis=1)
            fresh = 0 if tail is None else tail.shape[1]
            a, b = [], []
            for k in range(1, NEIGHBOURS + 1):
                i = np.arange(max(fresh, k), now.shape[1])
                i = i[(now[0, i] == now[0, i - k]) & (now[1, i] != now[1, i - k])]
                a.append(now[1, i])
                b.append(now[1, i - k])
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), pa.nulls(len(a), pa.int64())], names=["a", "b", "key"])
            tail = now[:, -NEIGHBOURS:]
        if tail is not None:
            ends.setdefault(int(tail[0, -1]), int(tail[1, -1]))
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array(list(ends.values()), pa.int64()), pa.nulls(len(ends), pa.int64()), pa.array(list(ends), pa.int64())], names=["a", "b", "key"])

    ordered = rows.repartitionByRange(partitions, "key", "code", "id").sortWithinPartitions("key", "code", "id")
    found = durable(ordered.mapInArrow(run, "a long, b long, key long").groupBy("a", "b", "key").agg(F.count("*").alias("hits")))
    border = found.where("key IS NOT NULL").select("key", "a")
    hub = border.groupBy("key").agg(F.min("a").alias("b"))
    over = border.join(hub, "key").where("a > b").select("a", "b", F.lit(1).cast("long").alias("hits"))
    return found.where("key IS NULL").select("a", "b", "hits").union(over)


class Verifier:
    """Confirms pairs on the full shingle sets of the documents that can occur in pairs."""

    def __init__(self, docs: DataFrame, ids: DataFrame, width: int, percent: int) -> None:
        self.percent = percent

        def run(batches):
            for batch, texts in byte_batches(batches, "text"):
                sets = shingle_sets(texts, width)
                flat = np.concatenate(sets).view(np.int64)
                at = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["id", "shingles"])
            give_back()

        ids = durable(ids)
        few = ids.count() <= BROADCAST_IDS
        own = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
        wanted = own.join(F.broadcast(ids) if few else ids, "id", "left_semi")
        self.sets = durable(wanted.mapInArrow(run, "id long, shingles array<long>"))

    def packed(self) -> DataFrame:
        """(id, packed): shortened hashes of each set, to be compared in one task."""

        def run(batches):
            for batch in batches:
                flat = batch.column(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack_set(np.asarray(flat[i].values, dtype=np.int64).view(np.uint64)) for i in range(batch.num_rows)], pa.binary())], names=["id", "packed"])

        return self.sets.select("id", "shingles").mapInArrow(run, "id long, packed binary")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar enough."""
        left = self.sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
        right = self.sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        return pairs.join(left, "a").join(right, "b").where(100 * both >= self.percent * (F.size("sa") + F.size("sb") - both)).select("a", "b").distinct()


def roots(parents: DataFrame, doublings: int = 3) -> DataFrame:
    """(id, c): where 2^doublings steps along ``parents`` (a, b), a > b, lead; nodes without parent have no row."""
    at = parents.select(F.col("a").alias("id"), F.col("b").alias("c"))
    for _ in range(doublings):
        on = at.select(F.col("id").alias("c"), F.col("c").alias("d"))
        at = at.join(on, "c", "left").select("id", F.coalesce("d", "c").alias("c"))
    return at


def pack_set(shingles: np.ndarray) -> bytes:
    """The upper ``SET_BYTES`` bytes of each sorted hash."""
    return np.ascontiguousarray(shingles.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES]).tobytes()


def unpack_set(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // SET_BYTES, 8), dtype=np.uint8)
    out[:, :SET_BYTES] = np.frombuffer(packed, dtype=np.uint8).reshape(-1, SET_BYTES)
    return out.view(">u8").ravel().astype(np.uint64)


def connect(t: pa.Table, percent: int) -> pa.Table:
    """Links (a, b), a > b, that join components of a region's rows: a forest, so fewer than there are rows.

    Each row outside of the largest component is held against all rows of other components, the likeliest first; those
    whose signatures rule them out are passed over, the others are compared on the full sets.
    """
    ids, sets = t.column("id").to_numpy(), [unpack_set(x) for x in t.column("packed").to_pylist()]
    size = np.array([len(x) for x in sets])
    codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), dtype=np.int64).reshape(len(ids), TREES)
    values = np.concatenate([(codes >> (12 * k)) & 0xFFF for k in range(DEPTH)], axis=1).astype(np.int16)
    part, other = (t.column(x).to_numpy() for x in ("part", "other"))
    left = np.flatnonzero(part == np.minimum(part, other).min())
    right = np.flatnonzero(part == np.maximum(part, other).max())
    label = np.unique(t.column("c").to_numpy(), return_inverse=True)[1]
    main = np.bincount(label).argmax()
    share = percent / 100
    least = share - 6 * (share * (1 - share) / values.shape[1]) ** 0.5
    in_left = np.isin(np.arange(len(ids)), left)
    found: list[tuple[int, int]] = []
    for i in np.flatnonzero(label != main).tolist():
        across = right if in_left[i] else left
        j = across[label[across] != label[i]]
        # Sets of one size can't be more alike than the smaller is to the larger.
        j = j[100 * np.minimum(size[j], size[i]) >= percent * np.maximum(size[j], size[i])]
        near = (values[j] == values[i]).mean(axis=1)
        j = j[near >= least][np.argsort(-near[near >= least], kind="stable")]
        while len(j):
            some, j = j[:32], j[32:]
            flat = np.concatenate([sets[k] for k in some])
            at = np.minimum(np.searchsorted(sets[i], flat), size[i] - 1)
            common = np.add.reduceat((sets[i][at] == flat).astype(np.int64), np.append(0, np.cumsum(size[some])[:-1]))
            for k in some[100 * common >= percent * (size[i] + size[some] - common)].tolist():
                if label[k] != label[i]:
                    found.append((max(int(ids[i]), int(ids[k])), min(int(ids[i]), int(ids[k]))))
                    label[label == label[k]] = label[i]
            j = j[label[j] != label[i]]
    if len(ids) > 1000:
        give_back()
    return pa.Table.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])


def rest_of_regions(regions: DataFrame, one_each: DataFrame, packed: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join the components of regions that hold several.

    A region over ``REGION_ROWS`` is cut into parts, and every two parts meet in a task of their own.
    """
    known = regions.join(comp, "id", "left").withColumn("c", F.coalesce("c", "id"))
    mixed = known.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select("key")
    parts = F.ceil(F.col("members") / F.lit(REGION_ROWS)).cast("int")
    codes = one_each.select("id", F.substring("labels", 8 * TREES + 1, 8 * TREES).alias("codes"))
    rows = known.join(mixed, "key").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1))).join(codes.join(packed, "id"), "id")
    met = rows.groupBy("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
    return met.applyInArrow(lambda t: connect(t, percent), "a long, b long").distinct()


def linked(docs: DataFrame, one_each: DataFrame, width: int, percent: int) -> DataFrame:
    """(u, v): documents of ``one_each`` in a component with others, and its smallest document."""
    partitions = shuffle_partitions(docs.sparkSession)
    rows = tree_rows(one_each)
    crowded = rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    regions = durable(rows.join(crowded, "key"))
    near = neighbours(regions, partitions)
    best = near.groupBy("a").agg(F.max(F.struct("hits", "b"))["b"].alias("b"))
    verifier = Verifier(docs, regions.select("id").distinct(), width, percent)
    forest = durable(verifier.confirm(best))
    comp = durable(roots(forest))
    edges = verifier.confirm(rest_of_regions(regions.select("key", "id", "members"), one_each, verifier.packed(), comp, percent))
    return components(comp.select(F.col("id").alias("u"), F.col("c").alias("v")).union(edges))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    described = durable(describe(docs, width))
    own = described.where("n > 0 AND id IS NOT NULL")
    equal = durable(own.groupBy("f1", "f2").agg(F.min("id").alias("id"), F.first("labels").alias("labels"), F.count("*").alias("copies")))
    comp = linked(docs, equal, width, percent)
    # Rows that repeat a doc_id can have several sets; they are one document.
    several = own.groupBy("id").agg(F.min("f1").alias("l1"), F.max("f1").alias("m1")).where("l1 <> m1").select("id")
    if not several.isEmpty():
        same = own.join(several, "id").join(equal.select("f1", "f2", F.col("id").alias("v")), ["f1", "f2"]).select(F.col("id").alias("u"), "v")
        comp = components(comp.union(same))
    found = equal.join(comp.select(F.col("u").alias("id"), F.col("v").alias("c")), "id", "left").where("copies > 1 OR c IS NOT NULL").select("f1", "f2", F.coalesce("c", "id").alias("c"))
    out = described.join(found.withColumnRenamed("f1", "g1").withColumnRenamed("f2", "g2"), (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n") > 0) & F.col("id").isNotNull(), "left")
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("c", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near-duplicates, with the columns of ``docs``.

    Rows that repeat a doc_id are one document: of those with the same text one stays, different texts all stay or go.
    """
    found = near_duplicates(docs, width, percent)
    gone = durable(found.where("NOT kept").select(F.col("doc_id").alias(free_name(docs, "gone_id"))).distinct())
    small = gone.count() <= BROADCAST_IDS
    out = docs.join(F.broadcast(gone) if small else gone, docs["doc_id"] == F.col(gone.columns[0]), "left_anti")
    if not found.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").isEmpty():
        # Rows that repeat id and text are one, the least by its other columns; other texts of an id stay.
        rest = [c for c in docs.columns if c not in ("doc_id", "text")]
        one = out.where("doc_id IS NOT NULL").groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest])).alias("rest"))
        one = one.select(*[F.col("rest")[c].alias(c) if c in rest else F.col(c) for c in docs.columns])
        out = one.unionByName(out.where("doc_id IS NULL"))
    return out


ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 1), ' ') AS g FROM p),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 80 * (na.n + nb.n - common)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.doc_id)
SELECT d.doc_id, COALESCE(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""
