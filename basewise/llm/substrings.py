"""Substring deduplication by hash-partitioned matching of windows of ``min_words`` words, in place of suffix trees.

Every window is a 64-bit label, and labels are dealt by slots of their first words, told by whole-corpus counts, into
groups that fit in memory; a slot that is too frequent is split by the rest of the label. A group sorts its labels, and
equal ones are a repeat. No suffix order, common prefixes or deeper nodes are built: every word of a longer repeat is in a
repeated window, so the words removed are the same. Consecutive windows of a text chain into spans.

Documents are dealt to chunks by ranges of doc_id, so that of two chunks one holds only smaller ids. A chunk sends each
distinct label once, however often it occurs there, without ids: a group sees a label once per chunk at most and answers
those chunks that aren't the first. Which document of a chunk has a label first is settled inside the chunk. So a passage
found in a third of all rows costs one label per chunk.

A word is removed when it lies in ``min_words`` consecutive words that also start in a row with a smaller doc_id; this is
judged on the input. Labels are 64-bit hashes that meet only inside a group, which tells further bits apart.

Defined cases: null text has no words; a row with null doc_id neither removes nor loses words; rows with the same doc_id
don't remove each other's words; texts shorter than ``min_words`` stay whole; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_batches, free_name, give_back, label_table, range_of, shuffle_partitions, window_hashes, words_of

SYMBOL_BITS, PREFIX_WORDS = 4, 3
SLOTS = 1 << (SYMBOL_BITS * PREFIX_WORDS)
GROUP_SUFFIXES = 1_000_000
CHUNK_TEXT = 4 << 20
NULL_ID = np.int64(np.iinfo(np.int64).min)


def suffix_labels(texts: list[bytes | None], min_words: int) -> tuple[np.ndarray, ...]:
    """(label, prefix slot, text, word) of each suffix with ``min_words`` words, and the first word of each text."""
    words, first, *_ = words_of(texts)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(first))
    n = len(words) - min_words + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64), first
    inside = np.flatnonzero(owner[:n] == owner[min_words - 1 :])
    symbol = (words >> np.uint64(64 - SYMBOL_BITS)).astype(np.int64)
    slot = np.zeros(n, dtype=np.int64)
    for k in range(PREFIX_WORDS):
        at = min(k, min_words - 1)
        slot = (slot << SYMBOL_BITS) | symbol[at : at + n]
    return window_hashes(words, min_words)[inside], slot[inside], owner[inside], inside, first


def prefix_counts(docs: DataFrame, min_words: int) -> tuple[np.ndarray, int]:
    """How many suffixes have each prefix slot, and the bytes of all texts."""

    def run(batches):
        counts, size = np.zeros(SLOTS, dtype=np.int64), 0
        for _, texts in byte_batches(batches, "text"):
            counts += np.bincount(suffix_labels(texts, min_words)[1], minlength=SLOTS)
            size += sum(len(x) for x in texts if x)
        slots = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(slots, -1)), pa.array(np.append(counts[slots], size))], names=["slot", "n"])

    text = docs.select(F.col("text").cast("binary").alias("text"))
    rows = text.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    counts, size = np.zeros(SLOTS, dtype=np.int64), 0
    for r in rows:
        if r["slot"] >= 0:
            counts[r["slot"]] = r["n"]
        else:
            size = r["n"]
    return counts, size


def prefix_groups(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first group, parts) of each slot and the number of groups, none over ``capacity`` but where one label repeats.

    Walks the prefix tree: a prefix whose suffixes fit is one unit, another is lengthened by a word, or split in parts
    at the longest length. Neighbouring units share a group while they fit.
    """
    group, parts = np.zeros(SLOTS, dtype=np.int64), np.ones(SLOTS, dtype=np.int64)
    state = {"at": 0, "filled": 0}

    def close() -> None:
        if state["filled"]:
            state["at"], state["filled"] = state["at"] + 1, 0

    def walk(lo: int, depth: int) -> None:
        width = 1 << (SYMBOL_BITS * (PREFIX_WORDS - depth))
        n = int(counts[lo : lo + width].sum())
        if n <= capacity:
            if state["filled"] + n > capacity:
                close()
            group[lo : lo + width] = state["at"]
            state["filled"] += n
        elif depth < PREFIX_WORDS:
            for child in range(1 << SYMBOL_BITS):
                walk(lo + child * (width >> SYMBOL_BITS), depth + 1)
        else:
            close()
            group[lo], parts[lo] = state["at"], -(-n // capacity)
            state["at"] += int(parts[lo])

    walk(0, 0)
    close()
    return group, parts, max(1, state["at"])


def repeated_windows(labels, owner, ids, repeated) -> np.ndarray:
    """Which windows start in a row with a smaller id, too; ``repeated``: sorted labels that start in a smaller chunk."""
    hit = np.zeros(len(labels), dtype=bool)
    if len(repeated):
        at = np.minimum(np.searchsorted(repeated, labels), len(repeated) - 1)
        hit = repeated[at] == labels
    doc = ids[owner]
    order = np.lexsort((doc, labels))
    run = np.ones(len(labels), dtype=bool)
    run[1:] = labels[order][1:] != labels[order][:-1]
    lowest = doc[order][np.maximum.accumulate(np.where(run, np.arange(len(labels)), 0))]
    hit[order] |= doc[order] > lowest
    return hit


def drop_repeats(docs: DataFrame, min_words: int = 13, n_words: str = "n_words", n_removed: str = "n_removed", spans: str = "removed", kept: str = "kept_text") -> DataFrame:
    """``docs`` with, in further columns, its words, removed words, their maximal spans [start, end) and the kept text.

    The kept text is the kept words joined by one space.
    """
    spark = docs.sparkSession
    partitions = shuffle_partitions(spark)
    counts, size = prefix_counts(docs, min_words)
    chunks = max(partitions, -(-size // CHUNK_TEXT))
    # A few groups for each partition, so that hashing deals them evenly enough.
    capacity = max(1, min(GROUP_SUFFIXES, -(-int(counts.sum()) // (4 * partitions))))
    group, parts, _ = prefix_groups(counts, capacity)
    bounds = docs.select(F.percentile_approx("doc_id", [i / chunks for i in range(1, chunks)], 20 * chunks).alias("b")).first()["b"] if chunks > 1 else []
    chunk, slot = free_name(docs, "chunk"), free_name(docs, "slot")
    # A row per CHUNK_TEXT bytes of text.
    labels = label_table(spark, chunks, partitions).select(F.col("slot").alias(slot), F.col("label").alias(chunk))
    dealt = docs.withColumn(slot, range_of(F.col("doc_id"), sorted(bounds or []))).join(F.broadcast(labels), slot)
    dealt = dealt.select(*[docs[c] for c in docs.columns], chunk, slot).repartition(partitions, chunk)
    shared = spark.sparkContext.broadcast((group, parts))

    def send(batches):
        group, parts = shared.value
        held: dict[tuple[int, int], list] = {}
        for batch, texts in byte_batches(batches, "text"):
            own, place = (batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in (chunk, slot))
            known = batch.column(batch.schema.get_field_index("doc_id")).is_valid().to_numpy(zero_copy_only=False)
            label, prefix, owner, _, _ = suffix_labels(texts, min_words)
            to = group[prefix] + (label % parts[prefix].astype(np.uint64)).astype(np.int64)
            for c in np.unique(own):
                mine = (known & (own == c))[owner]
                held.setdefault((int(c), int(place[own == c][0])), []).append((label[mine], to[mine].astype(np.int32)))
        for c, at_slot in list(held):
            found = held.pop((c, at_slot))
            label, at = np.unique(np.concatenate([x for x, _ in found]), return_index=True)
            to = np.concatenate([x for _, x in found])[at]
            order = np.argsort(to, kind="stable")
            label, to = label[order], to[order]
            edge = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.empty(0, dtype=np.int64)
            end = np.append(edge[1:], len(to))
            yield pa.RecordBatch.from_arrays(
                [pa.array(to[edge].astype(np.int32)), *(pa.array(np.full(len(edge), x, dtype=np.int32)) for x in (c, at_slot)), pa.array([label[a:b].tobytes() for a, b in zip(edge, end, strict=True)], pa.binary())],
                names=["g", "c", "slot", "labels"],
            )

    def meet(t: pa.Table) -> pa.Table:
        own, place = t.column("c").to_pylist(), t.column("slot").to_pylist()
        order = sorted(range(len(own)), key=lambda i: place[i])
        arrays = [np.frombuffer(t.column("labels")[i].as_py(), dtype=np.uint64) for i in order]
        label = np.concatenate(arrays)
        source = np.repeat(np.arange(len(order), dtype=np.int32), [len(x) for x in arrays])
        by = np.argsort(label, kind="stable")
        again = np.zeros(len(label), dtype=bool)
        again[1:] = label[by][1:] == label[by][:-1]
        label, source = label[by][again], source[by][again]
        by = np.argsort(source, kind="stable")
        cut = np.searchsorted(source[by], np.arange(len(order) + 1))
        give_back()
        rows = [(own[order[k]], label[by[cut[k] : cut[k + 1]]].tobytes()) for k in range(len(order)) if cut[k + 1] > cut[k]]
        return pa.Table.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["c", "labels"])

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField(n_words, T.LongType()), T.StructField(n_removed, T.LongType()), T.StructField(spans, span), T.StructField(kept, T.StringType())])
    arrow_span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        blobs = right.column("labels").to_pylist()
        repeated = np.sort(np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in blobs])) if blobs else np.empty(0, dtype=np.uint64)
        left = left.combine_chunks()
        id_column = left.column("doc_id")
        known = id_column.is_valid().to_numpy()
        ids = id_column.fill_null(int(NULL_ID)).to_numpy().astype(np.int64)
        found, base_doc, base_word, n_of = [], 0, 0, []
        for _, texts in byte_batches(iter(left.to_batches()), "text"):
            label, _, owner, word, first = suffix_labels(texts, min_words)
            keep = known[base_doc + owner]
            found.append((label[keep], (owner[keep] + base_doc).astype(np.int32), word[keep] + base_word))
            n_of.append(np.diff(first))
            base_doc, base_word = base_doc + len(texts), base_word + first[-1]
        n_of = np.concatenate(n_of) if n_of else np.empty(0, dtype=np.int64)
        label, owner, word = (np.concatenate([x[k] for x in found]) if found else np.empty(0, dtype=np.int64) for k in range(3))
        hit = repeated_windows(label.astype(np.uint64), owner, ids, repeated)
        word = word[hit].astype(np.int64)
        cover = np.bincount(word, minlength=base_word + min_words) - np.bincount(word + min_words, minlength=base_word + min_words)
        gone = np.cumsum(cover)[:base_word] > 0
        first = np.append(0, np.cumsum(n_of))
        text = left.column("text").cast(pa.binary())
        removed, all_spans, texts = [], [], []
        for i, x in enumerate(text):
            x = (x.as_py() or b"").split()
            g = gone[first[i] : first[i + 1]]
            n = int(g.sum())
            removed.append(n)
            if n:
                edge = np.flatnonzero(np.diff(np.concatenate(([0], g.astype(np.int8), [0]))))
                all_spans.append([{"start": a, "end": b} for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True)])
                x = [w for w, out in zip(x, g.tolist(), strict=True) if not out]
            else:
                all_spans.append([])
            texts.append(b" ".join(x).decode("utf-8", "replace"))
        columns = [left.column(i) for i, name in enumerate(left.schema.names) if name not in (chunk, slot)]
        give_back()
        return pa.Table.from_arrays([*columns, pa.array(n_of, pa.int64()), pa.array(removed, pa.int64()), pa.array(all_spans, arrow_span), pa.array(texts, pa.string())], names=schema.names)

    answers = dealt.mapInArrow(send, "g int, c int, slot int, labels binary").groupBy("g").applyInArrow(meet, "c int, labels binary")
    return dealt.groupBy(chunk).cogroup(answers.groupBy("c")).applyInArrow(settle, schema)


def digests(docs: DataFrame, min_words: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of ``docs``."""
    out = drop_repeats(docs.select("doc_id", "text"), min_words)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, min_words: int = 13) -> DataFrame:
    """The rows of ``docs``, repeated passages cut out of their texts, ``n_chars`` following where there is one.

    A text that loses no word stays as it is.
    """
    names = {k: free_name(docs, k) for k in ("n_words", "n_removed", "removed", "kept_text")}
    out = drop_repeats(docs, min_words, names["n_words"], names["n_removed"], names["removed"], names["kept_text"])
    changed = F.col(names["n_removed"]) > 0
    out = out.withColumn("text", F.when(changed, F.col(names["kept_text"])).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d),
x AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS s FROM p),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM x),
r AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS pos FROM f WHERE least < doc_id),
a AS (SELECT doc_id, list(pos) AS gone FROM r GROUP BY doc_id),
k AS (SELECT d.doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
m AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.pos) AS kept FROM k LEFT JOIN r ON r.doc_id = k.doc_id AND r.pos = k.pos WHERE r.pos IS NULL GROUP BY k.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, COALESCE(len(a.gone), 0)::BIGINT AS n_removed, sha256(COALESCE(m.kept, '')) AS kept_sha256
FROM d LEFT JOIN a ON a.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""
