"""Cost-balanced packing of token documents into fixed-length sequences.

Documents are tokenised once. Whole sequences are cut off long documents; the remainders are dealt by hash into groups
whose number follows the documents and their bytes, not the cluster. In a group the number of sequences is what the tokens fill, and the remainders, in descending
estimated cost (linear plus quadratic attention cost of the piece), each go to the sequence of lowest cost that has
room for them; one that fits nowhere is cut over the sequences of lowest cost. A group's padding is less than one
sequence in all.

Tokens come from a byte-level BPE vocabulary file. The text is split into the vocabulary's pre-tokens by numpy over
code points, equal pre-tokens are encoded once and kept by hash, so that frequent words cost a lookup. Texts that hold
an added token's string go through the vocabulary's own tokenizer.

Defined cases: a null text is empty and has only the closing id; rows that repeat a doc_id are packed row by row; an
empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
import json
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_batches, give_back, mix, span_hashes

SEQUENCE = 1024
#: Documents of which the remainders meet in one group: so many at least and at most, and in between by bytes of text.
GROUP_DOCUMENTS, MOST_DOCUMENTS, GROUP_BYTES = 8192, 1 << 16, 4 << 20
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Fixed values of the vocabulary's splitting pattern: the endings split off after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_state: dict = {}


def _classes() -> np.ndarray:
    """The class of every code point."""
    if "classes" not in _state:
        kinds = {"L": LETTER, "N": NUMBER, "Z": SPACE}
        out = np.full(0x110000, OTHER, dtype=np.uint8)
        for c in range(0x110000):
            out[c] = kinds.get(unicodedata.category(chr(c))[0], OTHER)
        out[[9, 10, 11, 12, 13, 0x85]] = SPACE
        _state["classes"] = out
    return _state["classes"]


def vocabulary(path: str) -> tuple[dict[str, int], dict[bytes, int]]:
    """(added tokens, ranks) of a vocabulary file: JSON of a byte-level model, or lines of base64 and rank."""
    if not path.endswith(".json"):
        with open(path, "rb") as lines:
            return {}, {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    added = {x["content"]: x["id"] for x in held["added_tokens"]}
    return added, {bytes(back[c] for c in k): v for k, v in held["model"]["vocab"].items() if k not in added}


class Encoder:
    """Ids of whole texts by a byte-level BPE vocabulary, with a bounded cache of pre-tokens."""

    def __init__(self, path: str, cache: int = 600_000) -> None:
        import tiktoken

        self.added, ranks = vocabulary(path)
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.encode = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.path, self.limit = path, cache
        self._clear()
        rng = np.random.default_rng(7)
        self.code = rng.integers(1, 1 << 63, 1 << 12, dtype=np.uint64) | np.uint64(1)

    def _clear(self) -> None:
        self.known = np.empty(0, dtype=np.uint64)
        self.at = np.empty(0, dtype=np.int64)
        self.count = np.empty(0, dtype=np.int32)
        self.ids = np.empty(0, dtype=np.uint32)

    def _codes(self, points: np.ndarray) -> np.ndarray:
        low = self.code[points & np.uint32(0xFFF)]
        high = points >> np.uint32(12)
        return np.where(high > 0, mix(low ^ high.astype(np.uint64)), low) if high.any() else low

    def special(self, text: str) -> np.ndarray:
        from tokenizers import Tokenizer

        if "own" not in _state:
            _state["own"] = Tokenizer.from_file(self.path)
        return np.array(_state["own"].encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def pieces(self, points: np.ndarray, doc_at: np.ndarray) -> np.ndarray:
        """Where pre-tokens start in the joined texts; ``doc_at``: where texts start, and the end."""
        kind = _classes()[points]
        n = len(points)
        run = np.empty(n, dtype=bool)
        run[0] = True
        np.not_equal(kind[1:], kind[:-1], out=run[1:])
        heads = doc_at[:-1][doc_at[:-1] < n]
        run[heads] = True
        start = run.copy()
        at = np.flatnonzero(run)
        ends = np.append(at[1:], n)
        doc_head = np.zeros(n + 1, dtype=bool)
        doc_head[doc_at] = True
        blank = (kind[at] == SPACE) & ~doc_head[ends]  # white space that something follows in its text
        last = ends[blank] - 1
        start[last] = True
        start[ends[blank][points[last] == 32]] = False
        lone = at[(kind[at] == OTHER) & (points[at] == 39) & (ends - at == 1)]
        for i in lone[start[lone]].tolist():
            tail = "".join(map(chr, points[i + 1 : min(i + 3, int(doc_at[np.searchsorted(doc_at, i, side="right")]))].tolist()))
            for c in CONTRACTIONS:
                if tail.startswith(c):
                    start[i + 1] = False
                    if i + 1 + len(c) < n:
                        start[i + 1 + len(c)] = True
                    break
        return np.flatnonzero(start)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        special, place, cut_at = self.places(texts)
        if not len(place):
            return [special.get(i, np.empty(0, dtype=np.uint32)) for i in range(len(texts))]
        count = self.count[place]
        total = np.append(0, np.cumsum(count, dtype=np.int64))
        flat = self.ids[np.repeat(self.at[place] - total[:-1], count) + np.arange(total[-1])]
        cut = total[cut_at]
        return [special[i] if i in special else flat[cut[i] : cut[i + 1]] for i in range(len(texts))]

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of ids of each text."""
        special, place, cut_at = self.places(texts)
        total = np.append(0, np.cumsum(self.count[place], dtype=np.int64))
        out = np.diff(total[cut_at])
        for i, ids in special.items():
            out[i] = len(ids)
        return out

    def places(self, texts: list[str]) -> tuple[dict[int, np.ndarray], np.ndarray, np.ndarray]:
        """(ids of texts that hold an added token, the cache's place of each pre-token, the first of each text and the end)."""
        special = {i: self.special(x) for i, x in enumerate(texts) if any(a in x for a in self.added)}
        plain = ["" if i in special else x for i, x in enumerate(texts)]
        joined = "".join(plain)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        doc_at = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(x) for x in plain], out=doc_at[1:])
        if not len(points):
            return special, np.empty(0, dtype=np.int64), np.zeros(len(texts) + 1, dtype=np.int64)
        starts = self.pieces(points, doc_at)
        ends = np.append(starts[1:], len(points))
        keys = span_hashes(self._codes(points), starts, ends)
        return special, self.look_up(keys, joined, starts, ends), np.searchsorted(starts, doc_at, side="left")

    def look_up(self, keys: np.ndarray, joined: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The cache's place of each pre-token, new ones being encoded."""
        unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known) > self.limit:
            self._clear()
        place = np.searchsorted(self.known, unique)
        missing = place == len(self.known)
        missing[~missing] = self.known[place[~missing]] != unique[~missing]
        if missing.any():
            new = [self.encode(joined[a:b]) for a, b in zip(starts[first[missing]].tolist(), ends[first[missing]].tolist(), strict=True)]
            size = np.fromiter(map(len, new), dtype=np.int32, count=len(new))
            at = np.cumsum(size) - size + len(self.ids)
            self.ids = np.concatenate([self.ids, np.fromiter((i for x in new for i in x), dtype=np.uint32, count=int(size.sum()))])
            into = place[missing]
            self.known = np.insert(self.known, into, unique[missing])
            self.at, self.count = np.insert(self.at, into, at), np.insert(self.count, into, size)
            place = np.searchsorted(self.known, unique)
        return place[inverse]


def encoder(path: str) -> Encoder:
    """One per Python worker and vocabulary."""
    if ("encoder", path) not in _state:
        _state["encoder", path] = Encoder(path)
    return _state["encoder", path]


def piece_cost(length: int, linear: float, quadratic: float) -> float:
    return linear * length + quadratic * length * length


def pack_group(lengths: np.ndarray, sequence: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document index, start in it, length, sequence, offset) for documents shorter than ``sequence``."""
    order = np.argsort(-lengths, kind="stable")
    n = -(-int(lengths.sum()) // sequence)
    # A heap of (cost, sequence) for each room, and over the rooms a tree of the cheapest in each subtree.
    size, none = 1 << sequence.bit_length(), (float("inf"), -1)
    room, heaps, best = [sequence] * n, [[] for _ in range(size)], [none] * (2 * size)

    def settle(r: int) -> None:
        at = r + size
        best[at] = heaps[r][0] if heaps[r] else none
        while at > 1:
            at >>= 1
            best[at] = min(best[2 * at], best[2 * at + 1])

    def cheapest(least: int) -> int:
        """The sequence of lowest cost with room for ``least`` tokens, or -1."""
        at = least + size
        found = best[at]
        while at > 1:
            if not at & 1:
                found = min(found, best[at + 1])
            at >>= 1
        return found[1]

    heaps[sequence] = [(0.0, k) for k in range(n)]
    settle(sequence)
    out = []
    for i in order.tolist():
        start, left = 0, int(lengths[i])
        whole = cheapest(left)
        while left:
            k = whole if whole >= 0 else cheapest(1)  # where none has room, it is cut over the cheapest that have any
            old = room[k]
            take = min(left, old)
            out.append((i, start, take, k, sequence - old))
            start, left, room[k] = start + take, left - take, old - take
            c, _ = heapq.heappop(heaps[old])
            settle(old)
            if room[k]:
                heapq.heappush(heaps[room[k]], (c + piece_cost(take, linear, quadratic), k))
                settle(room[k])
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, end_id: int = 0, linear: float = 1.0, quadratic: float = 1.0 / SEQUENCE) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    groups = max(1, min(rows // GROUP_DOCUMENTS, size // GROUP_BYTES), -(-rows // MOST_DOCUMENTS))

    def tokenise(batches):
        encode = encoder(tokenizer_path)
        for batch, texts in byte_batches(batches, "text"):
            rows: list[list] = [[], [], [], [], [], []]
            own = batch.column(0).to_pylist()
            for doc, ids in zip(own, encode([(x or b"").decode("utf-8", "replace") for x in texts]), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                for start in range(0, len(ids), sequence):
                    part = ids[start : start + sequence]
                    whole = len(part) == sequence
                    for column, v in zip(rows, (doc, start, len(part), zlib.crc32(part.astype("<u4").tobytes()) if whole else None, len(ids), None if whole else part.astype("<u4").tobytes()), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(),) * 5 + (pa.binary(),), strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
        give_back()

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(tokenise, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
    # The start is part of the key, so that the pieces of one long document spread.
    group = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), F.lit(groups))

    def fill(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("doc_tokens", "ascending")])
        own = t.column("g")[0].as_py() << 32
        whole = pa.compute.is_null(t.column("ids"))
        full, rest = t.filter(whole), t.filter(pa.compute.invert(whole))
        ids = rest.column("ids").to_pylist()
        plan = pack_group(np.array(rest.column("length").to_pylist(), dtype=np.int64), sequence, linear, quadratic)
        base, docs_, tokens = rest.column("start").to_pylist(), rest.column("doc_id").to_pylist(), rest.column("doc_tokens").to_pylist()
        out = [(docs_[i], base[i] + s, n, zlib.crc32(ids[i][4 * s : 4 * (s + n)]), tokens[i], own + k, at) for i, s, n, k, at in plan]
        first = own + (1 << 31)
        out += [(*r, first + k, 0) for k, r in enumerate(zip(*(full.column(c).to_pylist() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), strict=True))]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 7)], names=names)

    return cut.withColumn("g", group).groupBy("g").applyInArrow(fill, PIECES)
