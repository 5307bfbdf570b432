"""Language ID with a blended-spectrum string kernel, Nyström landmarks and one-versus-rest kernel ridge regression.

A text is the set of its byte n-grams for each length in ``orders`` (ASCII letters lower-cased), hashed to a fixed
number of slots. The kernel of two texts blends, over the lengths, the shared n-grams divided by the root of both
counts. Landmarks are labelled training texts; ridge regression against them gives a weight per landmark and language.
The kernel is linear in a text's presence vector, so landmarks and weights fold into one matrix per length, and texts
are scored by batches: presence matrix times folded matrix.

Texts are scored in pieces of at most ``PIECE`` bytes, so that a long text doesn't have every n-gram: its outputs are the
mean over its pieces, weighted by their lengths.

Training reads a bounded sample: at most ``per_language`` labelled texts of each language, by lowest id hash, none over
``longest_training_text`` characters. Prediction reads every whole text.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as is everything when no labelled text
is left to learn from; ties go to the language first in code-point order; rows are judged one by one, so repeats agree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _LOWER, byte_batches, crc_mod, free_name, give_back

SLOT_BITS = 13
#: Bytes of a text scored at once: more would fill the slots.
PIECE = 1 << 15


def presence(texts: list[bytes | None], n: int) -> np.ndarray:
    """A row per text: 1 in the slot of every byte n-gram that it has."""
    out = np.zeros((len(texts), 1 << SLOT_BITS), dtype=np.float32)
    joined = _LOWER[np.frombuffer(b"".join(x or b"" for x in texts), dtype=np.uint8)]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(x or b"") for x in texts])
    if len(joined) < n:
        return out
    m = len(joined) - n + 1
    code = np.zeros(m, dtype=np.uint32)
    for k in range(n):
        code = (code << np.uint32(8)) | joined[k : k + m]
    slot = (code * np.uint32(2654435761)) >> np.uint32(32 - SLOT_BITS)
    whole = owner[:m] == owner[n - 1 : n - 1 + m]
    out[owner[:m][whole], slot[whole]] = 1
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    orders: tuple[int, ...]
    folded: list[np.ndarray]
    sharpness: float

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """Regression outputs, a row per text and a column per language."""
        cuts = [(i, at) for i, x in enumerate(texts) for at in range(0, max(len(x or b""), 1), PIECE)]
        pieces = [(texts[i] or b"")[at : at + PIECE] for i, at in cuts]
        owner, size = np.array([i for i, _ in cuts], dtype=np.int64), np.array([max(len(x), 1) for x in pieces], dtype=float)
        each = np.zeros((len(pieces), len(self.languages)))
        for n, matrix in zip(self.orders, self.folded, strict=True):
            x = presence(pieces, n)
            each += (x @ matrix) / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]
        out = np.zeros((len(texts), len(self.languages)))
        np.add.at(out, owner, each * size[:, None])
        return out / np.bincount(owner, size, len(texts))[:, None]

    def predict(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        z = self.scores(texts) * self.sharpness
        best = z.argmax(axis=1)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return best, (p / p.sum(axis=1, keepdims=True))[np.arange(len(texts)), best]


def fit(texts: list[bytes], labels: list[str], orders=(1, 2, 3, 4), landmarks_per_language=40, ridge=1e-3, sharpness=4.0) -> LanguageModel:
    languages = sorted(set(labels))
    y = np.where(np.array([[x == k for k in languages] for x in labels]), 1.0, -1.0)
    chosen = [i for k in languages for i in [j for j, x in enumerate(labels) if x == k][:landmarks_per_language]]
    k_all, folded = np.zeros((len(texts), len(chosen))), []
    for n in orders:
        x = presence(texts, n)
        x /= np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]
        z = x[chosen]
        k_all += (x @ z.T) / len(orders)
        folded.append(z / len(orders))
    k_land = k_all[chosen]
    gram = k_all.T @ k_all + ridge * len(texts) * k_land + 1e-8 * np.eye(len(chosen))
    alpha = np.linalg.solve(gram, k_all.T @ y)
    return LanguageModel(languages, tuple(orders), [(z.T @ alpha).astype(np.float32) for z in folded], sharpness)


def train(docs: DataFrame, per_language: int = 300, longest_training_text: int = 200_000, **how) -> LanguageModel | None:
    """Fit on documents with a language whose crc32(doc_id) mod 4 isn't 2."""
    text = F.col("text")
    usable = docs.where(F.col("lang").isNotNull() & F.coalesce(crc_mod(F.col("doc_id"), 4) != 2, F.lit(False)))
    usable = usable.where((F.length(text) <= longest_training_text) & text.rlike(r"\p{L}")).select("doc_id", "lang", "text")
    counts = usable.groupBy("lang").count().collect()
    if not counts:
        return None
    order = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    # A share of each language, by hash, that holds somewhat more than is wanted; the rest is dropped below.
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(int((1 << 40) * min(1.0, (per_language * 1.5 + 20) / r["count"]))))])
    rows = usable.where(order < share[F.col("lang")]).select("lang", order.alias("o"), text.cast("binary").alias("text")).collect()
    taken: dict[str, int] = {}
    texts, labels = [], []
    for r in sorted(rows, key=lambda r: (r["lang"], r["o"], r["text"])):
        if taken.setdefault(r["lang"], 0) < per_language:
            taken[r["lang"]] += 1
            texts.append(bytes(r["text"]))
            labels.append(r["lang"])
    return fit(texts, labels, **how)


def identify(docs: DataFrame, model: LanguageModel | None, pred: str, score: str) -> DataFrame:
    """``docs`` with the predicted language and its score in two more columns."""
    letter = free_name(docs, "has_letter")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.withColumn(letter, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches):
        own = shared.value
        for batch, texts in byte_batches(batches, "text"):
            ok = np.array(batch.column(batch.num_columns - 1).to_pylist(), dtype=bool) & (own is not None)
            names, values = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
            if ok.any():
                at = np.flatnonzero(ok)
                best, values[at] = own.predict([texts[i] for i in at])
                names[at] = [own.languages[i] for i in best]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(values, pa.float64())], names=schema.names)
        give_back()

    return rows.mapInArrow(run, schema)


def predict_languages(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row."""
    model = train(docs, **how)
    own = docs.select("doc_id", "text", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"))
    return identify(own, model, "lang_pred", "score").select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least_lead: float = 0.2, **how) -> DataFrame:
    """The rows whose language is recognised, with the columns of ``docs``; without a model, those with a letter.

    A language is recognised if the score has come ``least_lead`` of the way from chance, one divided by the number of
    languages, to 1. With four languages that is a score of 0.4: words of other scripts and codes stay
    below, as do texts of a few letters; prose of a sentence or more scores 0.5 and over. One language leaves nothing to tell.
    """
    pred, score = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    model = train(docs, **how)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    chance = 1 / len(model.languages)
    out = identify(docs, model, pred, score)
    return out.where((F.col(pred) != "und") & (F.col(score) >= chance + least_lead * (1 - chance))).drop(pred, score)
