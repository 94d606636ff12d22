"""Sampled sub-word segmentations, and their lossless decoding.

The pieces that could cover a text form a lattice.  Forward filtering gives every
position the total weight of the ways to reach it; backward sampling then walks
from the end and draws each piece by its share of that weight.  Draws are hashes
of (seed, row key, place in the text), so a segmentation depends on nothing else.

No piece of a usable vocabulary crosses from a non-space to a space, so the
lattice falls apart into chunks (spaces, then non-spaces), which are filtered
once per slice and sampled at every place where they occur.  All steps run over
arrays of all chunks at once; lookups go on to longer pieces only where a longer
piece may end.  Characters without a piece of their own are
covered by the pieces of their bytes; so is the vocabulary's own space mark,
which keeps decoding lossless.

Cases: a null or empty text has no pieces; rows with equal keys and texts get
equal segmentations, also those without a key; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriparity.llm.common import BASE, mixed, powers, prefix_hashes, range_hashes, slices, texts_of

MARK = 0x2581  # how the vocabulary writes a space
OWN_MARK = 0x110000  # that character in a text
USER_SCORE = -1e8
BLOCK = 1 << 15  # characters hashed at once
PIECE, ENDING = 1, 2  # marks of a hash
BARE = -2  # less its code point: a character without a piece of its own


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces by the hash of their characters, and the bytes of each id."""

    def __init__(self, path: str | None, sharpness: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or default_model())
        self.bytes, names, weights = [], [], []
        self.byte_ids = np.zeros(256, np.int32)
        for i in range(model.get_piece_size()):
            name, score = model.id_to_piece(i), model.get_score(i)
            if model.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                self.bytes.append(bytes([int(name[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes.append(b"")
            else:
                self.bytes.append(name.replace(chr(MARK), " ").encode())
                names.append((name, i))
                # scores are minus the rank of a merge; ranks are weighed as in Zipf's law
                weights.append(-sharpness * np.log(2.0 + (-score if score > USER_SCORE else 0.0)))
        if any(chr(MARK) in n.lstrip(chr(MARK)) or "\n" in n for n, _ in names):
            raise ValueError("pieces of this model cross spaces")
        if not all(model.is_byte(i) for i in self.byte_ids.tolist()):
            raise ValueError("this model lacks pieces for bytes")
        lengths = np.array([len(n) for n, _ in names])
        self.longest = int(lengths.max())
        self.byte_weight = -sharpness * np.log(2.0 + model.get_piece_size())
        bits = int(np.ceil(np.log2(len(names)))) + 2
        self.shift, self.mark_shift = np.uint64(64 - bits), np.uint64(64 - bits - 3)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.ids = np.full(1 << bits, -1, np.int32)
        self.weights = np.full(1 << bits, -np.inf)
        self.marks = np.zeros(1 << (bits + 3), np.uint8)  # may be a piece, may be the end of a longer one
        text = "\0" + "\0".join([n for n, _ in names])
        hashes = prefix_hashes(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64))
        ends, keys = np.cumsum(lengths + 1) - 1, np.zeros(len(names), np.uint64)
        for n in range(1, self.longest + 1):
            at = np.flatnonzero(lengths >= n)
            found, whole = self.key(hashes[ends[at]], hashes[ends[at] - n], n), lengths[at] == n
            keys[at[whole]] = found[whole]
            self.marks[found[whole] >> self.mark_shift] |= PIECE
            self.marks[found[~whole] >> self.mark_shift] |= ENDING
        mask = len(self.keys) - 1
        for key, (_, i), weight in zip(keys.tolist(), names, weights, strict=True):
            at = key >> int(self.shift)
            while self.ids[at] >= 0:
                at = (at + 1) & mask
            self.keys[at], self.ids[at], self.weights[at] = key, i, weight

    @staticmethod
    def key(end: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
        """Hash of the characters between two prefixes, ``length`` of them."""
        with np.errstate(over="ignore"):
            power = np.uint64(pow(int(BASE), length, 2**64))
            return mixed(end - start * power + np.uint64(length))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are pieces, and their slots in the table."""
        slots = (keys >> self.shift).astype(np.int64)
        same = self.keys[slots] == keys
        rest = np.flatnonzero(~same)
        while len(rest):
            rest = rest[self.ids[slots[rest]] >= 0]
            slots[rest] = (slots[rest] + 1) & (len(self.keys) - 1)
            same[rest] = self.keys[slots[rest]] == keys[rest]
            rest = rest[~same[rest]]
        found = np.flatnonzero(same)
        found = found[self.ids[slots[found]] >= 0]  # an empty slot has the key 0
        return found, slots[found]

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8")[1:]


@lru_cache(2)
def vocabulary(path: str | None, sharpness: float) -> Vocabulary:
    return Vocabulary(path, sharpness)


class Slice:
    """The characters of texts, each text behind a space, cut into chunks; equal chunks are of one kind."""

    def __init__(self, texts: list[str]):
        self.counts = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.plain = np.frombuffer("".join([" " + t for t in texts if t]).encode("utf-32-le"), np.uint32)
        self.hashes = np.zeros(len(self.plain) + 1, np.uint64)  # of all characters before each place
        power = powers(BASE, min(len(self.plain), BLOCK))
        for at in range(0, len(self.plain), BLOCK):
            part = self.plain[at : at + BLOCK]
            codes = part.astype(np.uint64)
            codes[part == MARK] = OWN_MARK
            codes[part == ord(" ")] = MARK
            self.hashes[at + 1 : at + 1 + BLOCK] = prefix_hashes(codes) + self.hashes[at] * power[: len(part)]
        blank = (self.plain == ord(" ")) | (self.plain == ord("\n"))
        new = blank.copy()
        new[1:] &= ~blank[:-1]
        new[self.first[self.counts > 0]] = True
        start = np.flatnonzero(new)
        self.end = np.append(start[1:], len(self.plain)) if len(start) else start
        sizes = self.end - start
        whole = range_hashes(self.hashes[1:], start, self.end) if len(start) else self.hashes[1:]
        kinds = pa.array(whole).dictionary_encode()
        self.kinds = kinds.indices.to_numpy().astype(np.int64)
        shown = np.empty(len(kinds.dictionary), np.int64)  # an occurrence of each kind
        shown[self.kinds] = np.arange(len(start))
        # chunks that share a hash only are kinds of their own
        other = np.repeat(start[shown[self.kinds]] - start, sizes)
        other += np.arange(len(other))
        differ = np.flatnonzero(self.plain.take(other, mode="clip") != self.plain)
        wrong = sizes[shown[self.kinds]] != sizes
        wrong[np.searchsorted(self.end, differ, side="right")] = True
        wrong = np.flatnonzero(wrong)
        self.kinds[wrong] = len(shown) + np.arange(len(wrong))
        shown = np.concatenate([shown, wrong])
        self.start, self.sizes = start[shown], sizes[shown]  # by kind


class Lattice:
    """Forward-filtered lattices of the kinds of chunks, one place per character and one before the first.

    Places lie by their depth in the chunk, and in each depth by falling size of the chunk, so a step of the filter works on runs of places.
    """

    def __init__(self, chunks: Slice, v: Vocabulary):
        sizes = chunks.sizes
        order = np.argsort(-sizes, kind="stable")
        self.rank = np.empty(len(sizes), np.int64)  # by kind: which one it is in each depth
        self.rank[order] = np.arange(len(sizes))
        alive = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0) + 1), side="right")
        self.base = np.cumsum(alive) - alive
        total = int(alive.sum())
        before = np.cumsum(sizes) - sizes
        depth = np.arange(1, total - len(sizes) + 1) - np.repeat(before, sizes)
        ends = depth + np.repeat(chunks.start, sizes)
        place = self.base[depth] + np.repeat(self.rank, sizes)
        self.ids = np.empty((v.longest, total), np.int32)  # filled where there are pieces, and for single characters
        self.ids[0] = -1
        weight = np.full((v.longest, total), -np.inf, np.float32)
        at = np.arange(len(ends))
        for n in range(1, v.longest + 1):
            end = ends[at]
            keys = v.key(chunks.hashes[end], chunks.hashes[end - n], n)
            marks = v.marks[keys >> v.mark_shift]
            likely = np.flatnonzero(marks & PIECE)
            found, slots = v.find(keys[likely])
            to = place[at[likely[found]]]
            self.ids[n - 1, to], weight[n - 1, to] = v.ids[slots], v.weights[slots]
            at = at[(marks >= ENDING) & (depth[at] > n)]
        bare = np.flatnonzero(self.ids[0, place] < 0)
        cp = chunks.plain[ends[bare] - 1]
        weight[0, place[bare]] = v.byte_weight * (1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000))
        self.ids[0, place[bare]] = BARE - cp.astype(np.int32)
        reach = np.zeros(total)
        # share of pieces up to each length; whole words of eight lengths, so that these can be counted at once
        self.upto = np.ones((total, -(-v.longest // 8) * 8), np.float32)
        for t in range(1, len(alive)):
            here = slice(self.base[t], self.base[t] + alive[t])
            k = min(t, v.longest)
            ways = reach[self.base[t - k : t][::-1, None] + np.arange(alive[t])]
            ways += weight[:k, here]
            most = ways.max(axis=0)
            ways -= most
            shares = np.exp(ways, out=ways)
            for n in range(1, k):
                shares[n] += shares[n - 1]
            reach[here] = most + np.log(shares[-1])
            self.upto[here, : k - 1] = (shares[:-1] / shares[-1]).T


def sample_slice(texts: list[str], keys: np.ndarray, v: Vocabulary, seed: int) -> list[np.ndarray]:
    """Sampled ids of each text; ``keys`` are 64-bit hashes of the rows' keys."""
    chunks = Slice(texts)
    lattice = Lattice(chunks, v)
    counts, first = chunks.counts, chunks.first
    rank, left, end = lattice.rank[chunks.kinds], chunks.sizes[chunks.kinds], chunks.end
    doc = np.searchsorted(first + counts, end)
    out = np.full(len(chunks.plain), -1, np.int32)
    del chunks  # large for long texts
    with np.errstate(over="ignore"):
        salt = (mixed(keys + np.uint64(seed) * BASE) - first.view(np.uint64) * BASE)[doc]
    while len(end):
        with np.errstate(over="ignore"):
            u = (mixed(salt + end.view(np.uint64) * BASE) >> np.uint64(40)).astype(np.float32) / 2**24
        at, last = lattice.base[left] + rank, end - 1
        below = lattice.upto.take(at, axis=0) <= u[:, None]
        n = np.bitwise_count(below.view(np.uint64)).sum(axis=1, dtype=np.int64)
        out[last] = lattice.ids[n, at]
        n += 1
        left, end = left - n, end - n
        go = np.flatnonzero(left)
        rank, left, end, salt = rank[go], left[go], end[go], salt[go]
    bare = np.flatnonzero(out <= BARE)
    keep = out != -1
    if len(bare):  # characters that are spelled by bytes
        spelled = [v.byte_ids[list(chr(c).encode())] for c in (BARE - out[bare]).tolist()]
        repeats = keep.astype(np.int64)
        repeats[bare] = [len(s) for s in spelled]
        ids = np.repeat(out, repeats)
        ids[ids <= BARE] = np.concatenate(spelled)
        ends = np.cumsum(repeats)
    else:
        ids, ends = out[keep], np.cumsum(keep)
    last = np.concatenate([[0], ends])[first + counts]
    return np.split(ids, last[:-1]) if len(last) else []


def sample_pieces(docs: DataFrame, model: str | None = None, seed: int = 0, sharpness: float = 2.0) -> DataFrame:
    """``doc_id`` and sampled ``ids`` of every text.

    ``sharpness`` scales the log weights: small values spread the draws, large ones keep to the best segmentation.
    ``model`` is the path of a model file that every executor can read.
    """

    def run(batches):
        v = vocabulary(model, sharpness)
        for part in slices(batches):
            keys = part["key"].to_numpy().view(np.uint64)
            ids = sample_slice(part["text"].to_pylist(), keys, v, seed)
            yield pa.RecordBatch.from_arrays([part["doc_id"], arrays_of(ids)], names=["doc_id", "ids"])

    return texts_of(docs, F.xxhash64("doc_id").alias("key")).mapInArrow(run, "doc_id long, ids array<int>")


def arrays_of(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


def decode_pieces(rows: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id`` and ``text`` of rows with ``ids``; null ids are an empty text."""

    def run(batches):
        v = vocabulary(model, 1.0)
        for part in batches:
            texts = [v.decode(x or ()) for x in part["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


ROUND_TRIP = "doc_id long, n_ids long, ids_crc32 long, lossless boolean"


def round_trips(docs: DataFrame, model: str | None = None, seed: int = 0, sharpness: float = 2.0) -> DataFrame:
    """Per row: number and digest of the sampled ids, and whether they decode to the text they came from."""

    def run(batches):
        v = vocabulary(model, sharpness)
        for part in slices(batches):
            texts = part["text"].to_pylist()
            ids = sample_slice(texts, part["key"].to_numpy().view(np.uint64), v, seed)
            yield pa.RecordBatch.from_arrays([
                part["doc_id"], pa.array([len(x) for x in ids], pa.int64()),
                pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                pa.array([v.decode(x.tolist()) == t for x, t in zip(ids, texts, strict=True)]),
            ], names=["doc_id", "n_ids", "ids_crc32", "lossless"])

    return texts_of(docs, F.xxhash64("doc_id").alias("key")).mapInArrow(run, ROUND_TRIP)
