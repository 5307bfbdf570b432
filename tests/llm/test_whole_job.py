"""The operators do the whole job: nothing is left out by a bound."""

import zlib

import numpy as np

from basewise.llm import html_extract, langid, lm, packing


def test_lm_learns_from_every_training_document(spark, docs, messy, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 500)
    _, network = lm.learn(docs.where("doc_id is not null"))
    assert network.trained == sum(len((r[1] or "").encode().split()) + 1 for r in messy if r[0] is not None) > 20 * 500
    for n in (1, 2, 17, 3000):
        ranges = lm.rounds(n)
        assert [k for lo, hi in ranges for k in range(lo, hi)] == list(range(n)) and max(hi - lo for lo, hi in ranges) <= lm.ROUND_SHARDS


def test_lm_learns_from_long_texts(spark):
    ids = [i for i in range(20) if zlib.crc32(str(i).encode()) % 5 != 1]
    only = spark.createDataFrame([(ids[0], "left right " * 20_000)], "doc_id long, text string")
    r = lm.score(only).first()
    assert r["n_tokens"] == 40_001 and r["score"] > 0.5 * r["base_score"]


def test_lm_trains_the_first_shard_alike_however_many_follow(monkeypatch, spark):
    text = b"left right up down " * 20
    docs = spark.createDataFrame([(i, text.decode()) for i in range(100)], "doc_id long, text string")
    words, _, starts, ends, joined = lm.words_of([text], lower=True)
    monkeypatch.setattr(lm, "rounds", lambda shards: [(0, 1)])
    for shards in (1, 3):
        monkeypatch.setattr(lm, "SHARD_TOKENS", 8100 // shards)
        units, network = lm.learn(docs)
        n = network.trained // 81
        assert n == 100 if shards == 1 else 0 < n < 100
        own = lm.Network(lm.learn_units(docs.select(docs["text"].cast("binary").alias("text")))[1])
        own.train(np.tile(np.append(units(words, ends, starts, joined), 0), n), np.tile(np.arange(81) == 0, n), streams=48, epochs=3)
        assert np.allclose(network.weights(), own.weights(), atol=1e-4)


def test_packing_cuts_only_what_fits_nowhere():
    rng = np.random.default_rng(3)
    mixed = np.clip(rng.lognormal(5.3, 1.0, 3000).astype(int), 1, 1023)
    two = np.concatenate([rng.integers(600, 1000, 700), rng.integers(20, 300, 1400)])
    for lengths in (mixed, two):
        plan = packing.pack_group(lengths, 1024, 1.0, 1 / 1024)
        n = -(-int(lengths.sum()) // 1024)
        room, cost = np.full(n, 1024), np.zeros(n)
        for i, start, size, k, offset in plan:
            assert offset == 1024 - room[k]
            fits = room >= (lengths[i] if start == 0 else 1)
            if start == 0 and size < lengths[i]:
                assert not fits.any()
            else:
                assert cost[k] <= cost[fits].min() + 1e-9
            room[k] -= size
            cost[k] += packing.piece_cost(size, 1.0, 1 / 1024)
        assert sum(p[2] for p in plan) == lengths.sum() and room.min() >= 0


def test_extraction_keeps_text_after_silent_elements_and_outside_blocks():
    model, one, two = html_extract.train(), "The first paragraph has a good many words that belong to the story.", "The second paragraph goes on about it and also has a good many words."
    for odd in ('<svg width="4"/>', "<svg />", "<p><select><option>a</p>", "<p><template>a</p>", "<p><svg><path></p>", "<svg><path>", "<p><svg><svg><path></svg>a</svg></p>", "<p><math><mi>x</mi></p>", "<p><button>a</p>"):
        text = model.extract(f"<html><body><article class='post'><p>{one}</p>{odd}<p>{two}</p></article><div class='footer'><svg><path></svg>a</div></body></html>")
        assert one in text and two in text, odd
    assert one not in model.extract(f"<article><p>{two}</p><p><template><div>{one}</div></template></p></article>")
    text = model.extract(f"{one}<br>{two}")
    assert one in text and two in text
    assert "Menu" not in model.extract(f"<a href='/'>Menu</a><html><body><article><p>{one}</p><p>{two}</p></article></body></html>")


def test_language_filter_keeps_documents_without_a_model(docs, messy):
    kept = langid.keep_identified(docs.withColumn("lang", docs["lang"].substr(100, 0)).replace("", None, ["lang"]))
    assert kept.columns == docs.columns and kept.count() == sum(1 for r in messy if r[1] and any(c.isalpha() for c in r[1])) > 0


def test_language_filter_rejects_what_no_language_fits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    junk = [(-1, "0x9f3a 7712 qq8 zzkx 19-22 #### vvv xx"), (-2, "\u3053\u3093\u306b\u3061\u306f \u4e16\u754c"), (-4, "\u043f\u0440\u0438\u0432\u0435\u0442 \u043a\u0430\u043a")]
    more = spark.createDataFrame([tuple({"doc_id": i, "text": t}.get(c) for c in docs.columns) for i, t in junk], docs.schema)
    kept = {r["doc_id"] for r in langid.keep_identified(docs.unionByName(more)).select("doc_id").collect()}
    assert not kept & {i for i, _ in junk}
    assert kept == {r["doc_id"] for r in docs.where("length(text) > 3").select("doc_id").collect()}


def test_languages_of_very_long_texts(docs):
    model = langid.train(docs)
    short = {r["lang"]: r["text"].encode() for r in docs.where("lang IS NOT NULL AND length(text) > 60").collect()}
    names = [k for k in model.languages if k in short]
    long = [b" ".join([short[k]] * (4_000_000 // len(short[k]))) for k in names]
    assert names and [model.languages[i] for i in model.predict(long)[0]] == names
    z, pieces = model.scores(long[:1])[0], [long[0][a : a + langid.PIECE] for a in range(0, len(long[0]), langid.PIECE)]
    assert np.allclose(z, np.average(model.scores(pieces), axis=0, weights=[len(p) for p in pieces]))
