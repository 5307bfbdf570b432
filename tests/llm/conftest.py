import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, size int, h double, n_words int, c string, labels string, g int"


def rows(seed=4):
    """Small documents with nulls, empties, copies, near copies, shared passages, ties, repeated rows and a long text."""
    r = random.Random(seed)
    vocabulary = {k: ["".join(r.choice(a) for _ in range(r.randint(2, 8))) for _ in range(300)] for k, a in {"aa": "abcdefg ".strip(), "bb": "hijklmno", "cc": "pqrstuéü"}.items()}
    words = lambda k, n: [r.choice(vocabulary[k]) for _ in range(n)]
    passage, texts = words("aa", 60), []
    for _ in range(60):
        k = r.choice(["aa", "bb", "cc"])
        w = words(k, r.randint(1, 120))
        if r.random() < 0.3:
            at = r.randint(0, len(w))
            w[at:at] = passage[: r.randint(10, 60)]
        texts.append((" ".join(w).capitalize() + r.choice([".", "\n", "  \t"]), k))
    for i in range(0, 24, 2):
        t, k = texts[i]
        w = t.split()
        if len(w) > 20 and i % 4:
            w[r.randint(0, len(w) - 1)] = "changed"
        texts.append((" ".join(w), k))
    texts += [(" ".join(words("bb", 6000)), "bb"), (" ".join(["same"] * 500), "aa"), (texts[3][0], texts[3][1])]
    out = [(i, t, k if i % 7 else None, f"s{min(i % 5, 2)}" if i % 11 else None, len(t)) for i, (t, k) in enumerate(texts)]
    out += [(500, None, "aa", "s1", None), (501, "", "aa", "s1", 0), (502, " \n\t ", None, "s0", 4), (503, "12345 !!!", "aa", "s0", 9), (None, texts[0][0], "aa", "s0", 1), (None, None, None, None, None)]
    out += [out[5], out[5], (504, "word", "bb", "s2", 4), (505, "one two", "bb", "s2", 7), (506, "two one Ünï \x85x", "cc", "s3", 12)]
    return [(*x, "x", 1, 0.5, 3, "y", "z", 9) for x in out]


@pytest.fixture(scope="session")
def messy():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, messy, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(messy, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("doc_id < -99")
