"""The document operators against brute force on a small messy table."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from basewise.llm import components as component_module
from basewise.llm import langid, lm, minhash, mixing, packing, substrings, token_rollup
from basewise.llm.common import window_hashes, words_of
from basewise.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def crc(doc_id, m):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % m


def key(r):
    return tuple((x is None, x) for x in r)


def test_words(messy):
    texts = [r[1].encode() if r[1] is not None else None for r in messy]
    hashes, first, starts, ends, joined = words_of(texts)
    seen = {}
    for i, r in enumerate(messy):
        own = words(r[1])
        assert first[i + 1] - first[i] == len(own)
        for w, h in zip(own, hashes[first[i] : first[i + 1]].tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert len(set(window_hashes(hashes[:50], 3).tolist())) >= 40


def brute_substrings(rows, k=13):
    least = {}
    for r in rows:
        w = words(r[1])
        for i in range(len(w) - k + 1):
            s = tuple(w[i : i + k])
            if r[0] is not None:
                least[s] = min(least.get(s, r[0]), r[0])
    out = []
    for r in rows:
        w = words(r[1])
        gone = set()
        for i in range(len(w) - k + 1):
            if r[0] is not None and least[tuple(w[i : i + k])] < r[0]:
                gone |= set(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), kept))
    return out


def test_substrings(spark, docs, messy, empty):
    want = brute_substrings(messy)
    assert sum(w[2] > 0 for w in want) > 10
    got = [tuple(r) for r in substrings.digests(docs).collect()]
    assert sorted(got, key=key) == sorted([(a, b, c, hashlib.sha256(d.encode()).hexdigest()) for a, b, c, d in want], key=key)
    assert substrings.digests(empty).count() == 0
    kept = substrings.without_repeats(docs)
    assert kept.columns == docs.columns
    texts = sorted([(r["doc_id"], r["text"]) for r in kept.collect()], key=key)
    assert texts == sorted([(r[0], w[3] if w[2] else r[1]) for r, w in zip(messy, want, strict=True)], key=key)


def test_prefix_groups_fit():
    counts = np.random.default_rng(1).integers(0, 50, substrings.SLOTS)
    counts[[5, 77]] = 9000
    group, parts, n = substrings.prefix_groups(counts, 1000)
    load = collections.Counter()
    for g, p, c in zip(group.tolist(), parts.tolist(), counts.tolist(), strict=True):
        for k in range(p):
            load[g + k] += c / p
    assert max(load.values()) <= 1000 and max(load) < n and parts[5] == 9


def test_mixing(docs, messy, empty):
    sizes = collections.Counter()
    for r in messy:
        sizes[r[3]] += len(words(r[1]))
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        free -= full
    got = mixing.mix(docs).collect()
    assert len(got) == len(messy)
    taken = collections.Counter()
    source = {r[0]: r[3] for r in messy if r[0] is not None}
    largest = collections.Counter()
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        if r["doc_id"] is not None:
            s = source[r["doc_id"]]
            assert r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6
            taken[s] += r["taken"]
            largest[s] = max(largest[s], r["size"])
    sizes_of = collections.defaultdict(list)
    for r in messy:
        sizes_of[r[3]].append(len(words(r[1])))
    for s in names:
        # Within a small document of the target, or without one that would fit.
        missing = target[s] - sum(r["taken"] for r in got if r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6)
        assert -1e-6 <= missing <= max(largest[s] / 4, 1) or len(sizes_of[s]) < 5
    assert sorted(map(key, mixing.mix(docs).collect())) == sorted(map(key, got))
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns
    times = collections.Counter(r["doc_id"] for r in rows.collect())
    for r in got:
        if r["size"] and r["doc_id"] is not None and r["doc_id"] != 5:
            assert times[r["doc_id"]] == r["taken"] // r["size"]
    assert times[5] == sum(r["taken"] // r["size"] for r in got if r["doc_id"] == 5)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0


def test_mixing_takes_part_of_repeated_rows(spark):
    """Rows without id, and rows that repeat one id and text, are taken in part and alike on every run."""
    rows = [(None, f"w{i} a b", "x") for i in range(200)] + [(7, "a b c", "y")] * 300 + [(100 + i, "a b c d", "z") for i in range(500)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = sorted(map(key, mixing.mix(table.repartition(5), weights=(1.0, 1.0, 1.0), share=0.5).collect()))
    assert first == sorted(map(key, mixing.mix(table.repartition(3), weights=(1.0, 1.0, 1.0), share=0.5).collect()))
    out = mixing.mix(table, weights=(1.0, 1.0, 1.0), share=0.5).collect()
    for size in (600, 900, 2000):
        own = [r for r in out if r["source_size"] == size]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 4 and 0 < own[0]["target"] < size
    assert mixing.mixed_rows(table, weights=(1.0, 1.0, 1.0), share=0.5).count() == sum(r["taken"] // r["size"] for r in out)


def test_language(docs, messy, empty):
    got = {r["doc_id"]: r for r in langid.predict_languages(docs).collect() if r["doc_id"] is not None}
    for r in messy:
        if r[0] is None:
            continue
        assert got[r[0]]["held_out"] == (crc(r[0], 4) == 2) and 0 <= got[r[0]]["score"] <= 1
        if r[1] is None or not any(c.isalpha() for c in r[1]):
            assert got[r[0]]["lang_pred"] == "und"
    told = [r for r in messy if r[0] is not None and r[2] and len(words(r[1])) > 10 and "same" not in r[1]]
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in told) >= 0.95 * len(told)
    assert langid.predict_languages(empty).count() == 0
    nothing = langid.predict_languages(docs.withColumn("lang", docs["lang"].substr(100, 1)).replace("", None, ["lang"]))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter(r[0] for r in messy if r[1] and any(c.isalpha() for c in r[1]))


def brute_minhash(rows, k, percent=80):
    sets = collections.defaultdict(set)
    for r in rows:
        w = words((r[1] or "").translate(LOWER))
        if w and r[0] is not None:
            sets[r[0], tuple(w)] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}
    keys = list(sets)
    root = {a[0]: a[0] for a in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a[0]), find(b[0])))
                root[y] = x
    out = []
    for r in rows:
        w = tuple(words((r[1] or "").translate(LOWER)))
        c = find(r[0]) if r[0] in root else r[0]
        n = len({w[i : i + k] for i in range(len(w) - k + 1)} if len(w) >= k else {w}) if w else 0
        out.append((r[0], n, c, r[0] is None or r[0] == c))
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_minhash(docs, messy, empty, k):
    want = brute_minhash(messy, k)
    assert sum(not w[3] for w in want) >= 5
    assert sorted((tuple(r) for r in minhash.near_duplicates(docs, k).collect()), key=key) == sorted(want, key=key)
    if k == 5:
        assert minhash.near_duplicates(empty).count() == 0
        kept = minhash.keep_one(docs)
        assert kept.columns == docs.columns
        ids = [r["doc_id"] for r in kept.collect()]
        assert collections.Counter(ids) == collections.Counter({w[0]: 1 for w in want if w[3] and w[0] is not None}) + collections.Counter([None, None])


def test_keep_one_loses_no_text_of_a_repeated_id(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a, "x"), (1, b, "y"), (1, b, "z"), (2, a, "x"), (3, "alone here", None)]
    kept = minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, a, "x"), (1, b, "y"), (3, "alone here", None)], key=str)


@pytest.mark.parametrize("hub", [256, 1])
def test_components(spark, monkeypatch, hub):
    monkeypatch.setattr(component_module, "HUB_EDGES", hub)
    monkeypatch.setattr(component_module, "BROADCAST_HUBS", 10)
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(500, 560)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {x: find(x) for x in root if find(x) != x}
    assert {r["u"]: r["v"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()} == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_packed_sets():
    own = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2))
    back = minhash.unpack_set(minhash.pack_set(own))
    assert (back == (own >> np.uint64(24)) << np.uint64(24)).all() and len(minhash.unpack_set(b"")) == 0


def test_large_regions_meet_in_parts(monkeypatch, docs, messy):
    monkeypatch.setattr(minhash, "REGION_ROWS", 2)
    assert sorted((tuple(r) for r in minhash.near_duplicates(docs, 2).collect()), key=key) == sorted(brute_minhash(messy, 2), key=key)


def counts_of(paths):
    import base64

    import public_tokenizers
    import tiktoken

    path, own = tokenizer()
    with open(paths[1], "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    multi = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [lambda x: len(own.encode(x or "", add_special_tokens=False).ids), lambda x: len(multi.encode_ordinary(x or ""))]


def rollup_paths():
    files = pytest.importorskip("public_tokenizers")
    return [files.path("byte_bpe_50k.json"), files.path("byte_bpe_multi_50k.tiktoken")]


def test_token_rollup(spark, docs, messy, empty, tmp_path):
    paths = rollup_paths()
    count = counts_of(paths)
    rows = token_rollup.counted(docs, paths).persist()
    rollup = token_rollup.Rollup(spark, str(tmp_path / "r"))
    assert rollup.totals().count() == 0 and rollup.compact() == 0
    assert rollup.commit("a", token_rollup.insert(rows, "one")) and not rollup.commit("a", token_rollup.insert(rows, "one"))
    table = lambda: {(r["source"], r["lang"], r["tokenizer"]): (r["documents"], r["tokens"]) for r in rollup.totals().collect()}
    want = collections.Counter()
    for r in messy:
        want[r[3], r[2], "one"] += count[0](r[1])
    first = table()
    assert {k: v[1] for k, v in first.items()} == dict(want) and sum(v[0] for v in first.values()) == len(messy)
    assert rollup.compact() == 1 and rollup.compact() == 1 and table() == first
    # A revised text, then another version, and a second writer that lost.
    old = docs.where("doc_id = 3")
    new = old.withColumn("text", F.lit("only these words")).withColumn("lang", F.lit("zz"))
    assert rollup.commit("b", token_rollup.revise(token_rollup.counted(old, paths), token_rollup.counted(new, paths), "one"))
    key = next((r[3], r[2], "one") for r in messy if r[0] == 3)
    now = table()
    assert now[key[0], "zz", "one"] == (1, count[0]("only these words")) and now.get(key, (0, 0))[1] == first[key][1] - count[0](next(r[1] for r in messy if r[0] == 3))
    token_rollup.summed(token_rollup.insert(rows, "one")).write.parquet(str(tmp_path / "r" / "attempts" / "late"))
    assert not rollup._publish("attempts/late", "deltas/b") and not (tmp_path / "r" / "attempts" / "late").exists() and table() == now
    assert rollup.commit("c", token_rollup.revise(rows, rows, "one", 0, "two", 1)) and rollup.compact() == 2 and rollup.compact() == 2
    two = collections.Counter()
    for r in messy:
        two[r[3], r[2], "two"] += count[1](r[1])
    assert {k: v[1] for k, v in table().items() if k[2] == "two"} == dict(two)
    assert rollup.commit("none", token_rollup.insert(token_rollup.counted(empty, paths), "one")) and rollup.committed("none")
    assert rollup.overdrawn().count() == 1 and rollup.overdrawn().first()["lang"] == key[1]
    with pytest.raises(ValueError):
        rollup.commit("../x", token_rollup.insert(rows, "one"))


def test_replayed_history_ends_with_all_documents(spark, docs, messy, empty, tmp_path):
    paths = rollup_paths()
    versions = dict(zip(("one", "two"), paths, strict=True))
    want = collections.defaultdict(lambda: [0, 0])
    for name, count in zip(versions, counts_of(paths), strict=True):
        for r in messy:
            want[r[3], r[2], name][0] += 1
            want[r[3], r[2], name][1] += count(r[1])
    got = token_rollup.replay(docs, str(tmp_path / "r"), versions).collect()
    assert {(r["source"], r["lang"], r["tokenizer"]): [r["documents"], r["tokens"]] for r in got} == dict(want)
    assert token_rollup.replay(empty, str(tmp_path / "e"), versions).count() == 0


def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    return path, tokenizers.Tokenizer.from_file(path)


def test_encoder_equals_the_tokenizer():
    import random

    path, own = tokenizer()
    r, encode = random.Random(1), packing.Encoder(path, cache=50)
    parts = ["a", "b", "'", "'s", "'ll", " ", "  ", "\n", "\t", "1", "²", "é", "ß", "!", "?", "don't", "'t", " 're", "日本", "😀", "<|endoftext|>", "\r\n", '"', " ", "\x85"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(800)]
    for at in range(0, len(texts), 100):
        for x, ids in zip(texts[at : at + 100], encode(texts[at : at + 100]), strict=True):
            assert ids.tolist() == own.encode(x, add_special_tokens=False).ids, x


def test_packing(docs, messy, empty):
    path, own = tokenizer()
    ids = {(r[0], r[1]): np.array([*own.encode(r[1] or "", add_special_tokens=False).ids, 0], dtype="<u4") for r in messy}
    by_id = {k[0]: v for k, v in ids.items() if k[0] is not None}
    got = packing.pack(docs, path).collect()
    sequences, covered = collections.defaultdict(list), collections.Counter()
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        covered[r["doc_id"]] += r["length"]
        if r["doc_id"] is not None:
            x = by_id[r["doc_id"]]
            assert r["doc_tokens"] == len(x) and r["ids_crc32"] == zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes())
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 1024
    times = collections.Counter(r[0] for r in messy)
    assert all(covered[k] == len(v) * times[k] for k, v in by_id.items())
    assert packing.pack(empty, path).count() == 0


def test_pack_group_balances():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 1023, 400)
    plan = packing.pack_group(lengths, 1024, 1.0, 1 / 1024)
    fill = collections.Counter()
    for _, _, n, k, _ in plan:
        fill[k] += n
    assert len(fill) == -(-lengths.sum() // 1024) and sum(fill.values()) == lengths.sum() and max(fill.values()) <= 1024
    # Costs are balanced: far closer to each other than where documents are put in order into the first that has room.
    cost, plain = collections.Counter(), [0.0]
    for _, _, n, k, _ in plan:
        cost[k] += packing.piece_cost(n, 1.0, 1 / 1024)
    room = 1024
    for n in lengths.tolist():
        if n > room:
            plain.append(0.0)
            room = 1024
        room -= n
        plain[-1] += packing.piece_cost(n, 1.0, 1 / 1024)
    spread = lambda x: np.std(list(x)) / np.mean(list(x))
    assert spread(cost.values()) < 0.6 * spread(plain)


@pytest.mark.parametrize("partitions", ["3", "200"])
def test_packing_pads_little(spark, partitions):
    path, _ = tokenizer()
    r = np.random.default_rng(1)
    texts = [(i, " ".join("word" for _ in range(int(n)))) for i, n in enumerate(np.clip(r.lognormal(5, 1.2, 1000), 1, 20_000))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), path).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    tokens = sum(r["length"] for r in got)
    assert 1 - tokens / (1024 * len({r["sequence_id"] for r in got})) < 0.01


def test_lm(docs, messy, empty):
    tokens = {i: [*words((r[1] or "").translate(LOWER)), None] for i, r in enumerate(messy)}
    counts = collections.Counter(t for i, r in enumerate(messy) if r[0] is not None and crc(r[0], 5) != 1 for t in tokens[i])
    n, v = sum(counts.values()), len(counts)
    want = sorted([(r[0], crc(r[0], 5) == 1, len(t), sum(counts[x] > 0 for x in t), n, round(sum(np.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), 6)) for r, t in ((r, tokens[i]) for i, r in enumerate(messy))], key=key)
    out = lm.score(docs).collect()
    assert sorted([(*tuple(r)[:5], round(r["base_score"], 6)) for r in out], key=key) == want
    assert sum(r["score"] for r in out if r["doc_id"] is not None and r["n_tokens"] > 5) > sum(r["base_score"] for r in out if r["doc_id"] is not None and r["n_tokens"] > 5)
    assert lm.score(empty).count() == 0


def test_network_gradients_and_windows():
    rng = np.random.default_rng(0)
    net = lm.Network(rng.integers(1, 50, 30).astype(float), hidden=4, embed=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y, keep = rng.integers(0, 30, (5, 3)), rng.integers(0, 30, (5, 3)), np.ones((5, 3))
    x[0], keep[2, 1] = -1, 0
    start = np.zeros((4, 3))
    loss = lambda: -net.log_probs(net.flat(net.run(x, start, keep)[0]), y.ravel()).mean()
    g, _ = net.gradients(x, y, keep, start)
    for k in net.p:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        net.p[k][at] += 1e-3
        up = loss()
        net.p[k][at] -= 2e-3
        down = loss()
        net.p[k][at] += 1e-3
        assert abs((up - down) / 2e-3 - g[k][at]) < 1e-4
    sequences = [rng.integers(0, 30, k) for k in (1, 31, 32, 33, 100)]
    alone = [net.score([s])[0] for s in sequences]
    assert np.allclose(net.score(sequences), alone, rtol=1e-4)
    every = np.array([[net.log_probs(net.run(np.array([[-1]]), net.start(1))[0][0], np.array([u]))[0]] for u in range(30)])
    assert abs(np.exp(every).sum() - 1) < 1e-4
