"""Cross-tokenizer alignment by merge-path partitioning.

Two tokenizers cut the bytes of ``space + text`` into tokens.  Where tokens of both
end at one byte, the two tokens are linked, and these bytes cut the tokens of both
sides into groups that cover the same bytes.

1. Texts are encoded by both tokenizers and held as ascending token ends, text
   after text on one line of bytes.  A long text goes in segments, cut where a
   single space stands between two other characters: there neither tokenizer
   joins what lies on its two sides.
2. Merging the two lists of ends is a path through the grid of A ends by B ends.
   Diagonals ``PIECE`` steps apart are searched by bisection for the point where
   the path crosses them (``crossings``), which divides the merge into pieces of
   equal work whatever the lengths of texts and tokens.
3. The pieces are merged side by side (``merged``), each on its own, and report the
   A-B tokens that end together.  An end whose A stands last in one piece and whose
   B stands first in the next is stitched from the two, as are the groups that a
   piece leaves open.
4. Pairs of linked ids are counted over the corpus.  Two tokens that end together
   hold the same bytes as far as the shorter reaches, so one is a suffix of the
   other: there are fewer different pairs than bytes in both vocabularies, however
   large the corpus.  Only that table is sent to the tasks, which sum it up for
   the links of every document.

Tasks hold a segment of ``SEGMENT`` characters, one stretch without such a space at
least, and the different pairs of a document.

Cases: a null or empty text, and one whose tokens on either side don't add up to its
bytes, has no tokens: zeros, no groups and an empty digest; rows without doc_id
and repeated rows are documents of their own, and count in the corpus each; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriparity.llm.common import slices
from veriparity.session import cut_lineage

PIECE = 256
SEGMENT = 1 << 19
MOST_PAIRS = 1 << 21  # held of one document before they are summed up
CUT = re.compile(r"(?<=\S) (?=\S)")
BLANK_RUN = re.compile(r"\s{500}")  # longer ones overflow the stack of the faster library


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """Bytes by the letters that stand for them in a byte-level vocabulary: printable Latin-1, the others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteTokens:
    """Tokenizer A: byte-level BPE from a tokenizer file, without special tokens.

    The file must cut by the usual byte-level pattern and number tokens by the order of their merges; others raise.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.encode_special_tokens = True
        letters = byte_letters()
        special = {i for i, t in self.exact.get_added_tokens_decoder().items() if t.special}
        vocabulary = self.exact.get_vocab()
        told = json.loads(self.exact.to_str())
        cutter, joins = told["pre_tokenizer"] or {}, [m if isinstance(m, list) else m.split(" ") for m in told["model"].get("merges", [])]
        usual = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space") and not told["normalizer"]
        if not usual or any(vocabulary.get("".join(m)) != 256 + i for i, m in enumerate(joins)):
            raise ValueError(f"not a byte-level tokenizer numbered by merges: {path}")
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = token.encode() if i in special else bytes(letters[c] for c in token)
        import public_tokenizers

        # ids of this vocabulary are the order of its merges, so a library that merges by rank finds the same ids faster
        ranks = {self.bytes[i]: i for i in range(len(self.bytes)) if i not in special}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.slow(t) if BLANK_RUN.search(t) else self.fast.encode_ordinary(t) for t in (" " + t for t in texts)]

    def slow(self, text: str) -> list[int]:
        return self.exact.encode(text, add_special_tokens=False).ids


class PieceTokens:
    """Tokenizer B: sentence pieces with byte fallback, which put the space before the text themselves."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces that reach over a space")  # segments would not be encoded as the whole
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Tables:
    """Both tokenizers with the length of each token and the words of the written groups."""

    def __init__(self, path_a: str | None, path_b: str | None):
        default_a, default_b = (None, None) if path_a and path_b else default_paths()
        self.a, self.b = ByteTokens(path_a or default_a), PieceTokens(path_b or default_b)
        self.lengths = [np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b)]
        self.size_b = len(self.b.bytes)
        words = [f"{i}{end}" for side, last in ((self.a, "|"), (self.b, ";")) for i in range(len(side.bytes)) for end in (",", last)]
        self.words, self.words_b = pa.array(words, pa.large_binary()), 2 * len(self.a.bytes)


@lru_cache(1)
def tables(path_a: str | None, path_b: str | None) -> Tables:
    """One copy per Python worker, which lives on from task to task."""
    return Tables(path_a, path_b)


def segments(text: str, size: int) -> Iterator[str]:
    """The text in parts of about ``size`` characters; the spaces they were cut at stand before the next part."""
    start = 0
    while len(text) - start > size and (cut := CUT.search(text, start + size)):
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:] if start else text


def crossings(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge path of two ascending lists crosses every ``piece``-th diagonal, and its end; of equal ends A comes first."""
    diagonal = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    low, high = np.maximum(diagonal - len(b), 0), np.minimum(diagonal, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        before = np.zeros(len(diagonal), bool)
        at = np.flatnonzero(open_)
        before[at] = a[middle[at]] <= b[diagonal[at] - 1 - middle[at]]
        low = np.where(open_ & before, middle + 1, low)
        high = np.where(open_ & ~before, middle, high)
    return low, diagonal - low


def merged(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the A and B ends that are equal, both lists without repeats; all pieces take a step at a time."""
    at_a, at_b = crossings(a, b, piece)
    i, j, stop_a, stop_b = at_a[:-1].copy(), at_b[:-1].copy(), at_a[1:], at_b[1:]
    n = len(i)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    far = np.int64(2**62)
    a, b = np.append(a, far), np.append(b, far)
    last = np.full(n, -1, np.int64)  # the end that the piece took last from A
    first_b = np.full(n, -1, np.int64)  # the end that it took first, if that is of B
    found_a, found_b = [], []
    for step in range(piece):
        go = i + j < stop_a + stop_b
        next_a, next_b = np.where(i < stop_a, a[i], far), np.where(j < stop_b, b[j], far)
        take_a, take_b = go & (next_a <= next_b), go & (next_a > next_b)
        if step == 0:
            first_b[take_b] = next_b[take_b]
        together = np.flatnonzero(take_b & (last == next_b))
        found_a.append(i[together] - 1)
        found_b.append(j[together])
        last[take_a] = next_a[take_a]
        i, j = i + take_a, j + take_b
    # an end whose A is the last step of a piece and whose B is the first of the next
    closing = np.where(at_a[1:] > at_a[:-1], a[np.maximum(at_a[1:] - 1, 0)], -1)
    stitched = np.flatnonzero((first_b[1:] >= 0) & (first_b[1:] == closing[:-1])) + 1
    found_a.append(at_a[stitched] - 1)
    found_b.append(at_b[stitched])
    ends_a, ends_b = np.concatenate(found_a), np.concatenate(found_b)
    order = np.argsort(ends_a)
    return ends_a[order], ends_b[order]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


class Unit:
    """Alignment of some segments, each of which belongs to a row."""

    def __init__(self, t: Tables, rows: np.ndarray, texts: list[str], piece: int = PIECE):
        self.sound = np.zeros(len(texts), bool)
        encoded = [t.a.encode(texts), t.b.encode(texts)]
        want = [b" " + x.encode() for x in texts]
        for k, target in enumerate(want):
            self.sound[k] = all(
                b"".join(map(side.bytes.__getitem__, ids[k])) == target for side, ids in zip((t.a, t.b), encoded, strict=True)
            )
        keep = np.flatnonzero(self.sound)
        self.rows = rows[keep]
        ids = [np.fromiter(chain.from_iterable(e[k] for k in keep), np.int64) for e in encoded]
        self.n = [np.array([len(e[k]) for k in keep], np.int64) for e in encoded]
        self.ids_a, self.ids_b = ids
        ends = [np.cumsum(lengths[i]) for lengths, i in zip(t.lengths, ids, strict=True)]
        self.link_a, self.link_b = merged(*ends, piece)
        # every segment ends with a link, so links up to the last token of a segment are its own
        self.links = np.diff(np.searchsorted(self.link_a, np.cumsum(self.n[0]) - 1, side="right"), prepend=0)
        self.pairs = self.ids_a[self.link_a] * t.size_b + self.ids_b[self.link_b]
        self.link_rows = np.repeat(self.rows, self.links)

    def written(self, t: Tables) -> Iterator[memoryview]:
        """Groups of each sound segment, ``a1,a2|b1;a3|b2,b3;``."""
        group_a, group_b = np.diff(self.link_a, prepend=-1), np.diff(self.link_b, prepend=-1)
        code = np.zeros(len(self.ids_a) + len(self.ids_b), np.int64)
        ends = [np.zeros(len(x), np.int64) for x in (self.ids_a, self.ids_b)]
        ends[0][self.link_a], ends[1][self.link_b] = 1, 1
        code[np.arange(len(self.ids_a)) + np.repeat(self.link_b - group_b + 1, group_a)] = 2 * self.ids_a + ends[0]
        code[np.arange(len(self.ids_b)) + np.repeat(self.link_a + 1, group_b)] = t.words_b + 2 * self.ids_b + ends[1]
        words = t.words.take(pa.array(code))
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset :]
        data = memoryview(words.buffers()[2]) if len(code) else memoryview(b"")
        bounds = np.append(0, np.cumsum(self.n[0] + self.n[1]))
        for k in range(len(self.rows)):
            yield data[offsets[bounds[k]] : offsets[bounds[k + 1]]]

    def groups(self) -> pa.Array:
        """The ids of each group on both sides."""
        sides = []
        for ids, link in ((self.ids_a, self.link_a), (self.ids_b, self.link_b)):
            offsets = pa.array(np.append(0, link + 1).astype(np.int32))
            sides.append(pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))))
        return pa.StructArray.from_arrays(sides, names=["a", "b"])


def units(texts: list[str | None], segment: int) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Segments with the index of their text, about ``segment`` characters at a time."""
    rows, held, size = [], [], 0
    for k, text in enumerate(texts):
        for part in segments(text, segment) if text else ():
            rows.append(k)
            held.append(part)
            size += len(part)
            if size >= segment:
                yield np.array(rows), held
                rows, held, size = [], [], 0
    if rows:
        yield np.array(rows), held


PAIR = "array<struct<a: int, b: int, n: int>>"
ALIGNED = f"doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs {PAIR}"
GROUPS = "array<struct<a: array<int>, b: array<int>>>"


def aligned(
    docs: DataFrame, path_a: str | None = None, path_b: str | None = None, keep_groups: bool = False,
    segment: int = SEGMENT, piece: int = PIECE,
) -> DataFrame:
    """Per document: numbers of tokens, groups and links, a digest of the groups, and how often it links which ids.

    With ``keep_groups`` also ``groups``, the ids of A and of B in each.  The paths must be readable on every executor.
    """

    def run(batches):
        t = tables(path_a, path_b)
        for part in slices(batches):
            rows = part.num_rows
            n_a, n_b, n_links = (np.zeros(rows, np.int64) for _ in range(3))
            sound = np.ones(rows, bool)
            digests: list = [None] * rows
            keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            groups, group_rows = [], []
            space = len(t.a.bytes) * t.size_b
            for of, texts in units(part["text"].to_pylist(), segment):
                unit = Unit(t, of, texts, piece)
                sound[of[~unit.sound]] = False
                np.add.at(n_a, unit.rows, unit.n[0])
                np.add.at(n_b, unit.rows, unit.n[1])
                np.add.at(n_links, unit.rows, unit.links)
                for row, words in zip(unit.rows.tolist(), unit.written(t), strict=True):
                    if digests[row] is None:
                        digests[row] = hashlib.sha256()
                    else:
                        digests[row].update(b";")
                    digests[row].update(words[:-1])
                keys.append(unit.link_rows * space + unit.pairs)
                counts.append(np.ones(len(unit.pairs), np.int64))
                if sum(map(len, keys)) > MOST_PAIRS:
                    keys, counts = ([x] for x in summed(np.concatenate(keys), np.concatenate(counts)))
                if keep_groups:
                    groups.append(unit.groups())
                    group_rows.append(unit.link_rows)
            key, count = summed(np.concatenate(keys), np.concatenate(counts))
            use = sound[key // space]
            key, count = key[use], count[use]
            for x in (n_a, n_b, n_links):
                x[~sound] = 0
            pairs = pa.StructArray.from_arrays(
                [pa.array((x).astype(np.int32)) for x in (key % space // t.size_b, key % t.size_b, count)], names=["a", "b", "n"]
            )
            found = [d.hexdigest() if d is not None and ok else "" for d, ok in zip(digests, sound.tolist(), strict=True)]
            columns = [
                part["doc_id"], *(pa.array(x) for x in (n_a, n_b, n_links, n_links)), pa.array(found, pa.string()),
                pa.ListArray.from_arrays(offsets_of(key // space, rows), pairs),
            ]
            if keep_groups:
                owner = np.concatenate([np.zeros(0, np.int64), *group_rows])
                use = sound[owner]
                empty = pa.array([], pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
                columns.append(pa.ListArray.from_arrays(offsets_of(owner[use], rows), pa.concat_arrays([empty, *groups]).filter(pa.array(use))))
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "groups"]
            yield pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, ALIGNED + f", groups {GROUPS}" * keep_groups)


def offsets_of(owner: np.ndarray, rows: int) -> pa.Array:
    return pa.array(np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32))


def pair_counts(rows: DataFrame) -> DataFrame:
    """``a``, ``b``, ``links`` (how many links of the corpus hold both) and ``best``: no pair of ``b`` has more."""
    counts = rows.select(F.inline("pairs")).groupBy("a", "b").agg(F.sum("n").alias("links"))
    return counts.select("*", (F.col("links") == F.max("links").over(Window.partitionBy("b"))).alias("best"))


def weighed(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` of ``aligned`` with ``n_best`` and ``count_sum``: links whose pair is a best one, and the counts of all links."""
    spark = rows.sparkSession
    table = counts.toArrow().combine_chunks()  # fewer pairs than bytes in both vocabularies
    a, b, links, best = (table[c].to_numpy() for c in ("a", "b", "links", "best"))
    key = a.astype(np.int64) << 32 | b
    order = np.argsort(key)
    sent = spark.sparkContext.broadcast((key[order], links[order], best[order].astype(np.int64)))

    def run(batches):
        keys, links, best = sent.value
        for batch in batches:
            lists = batch["pairs"]
            flat = lists.flatten()
            a, b, n = (np.asarray(flat.field(k)).astype(np.int64) for k in range(3))
            at = np.searchsorted(keys, a << 32 | b)
            ends = np.append(0, np.cumsum(np.asarray(lists.value_lengths())))
            sums = []
            for x in (best, links):
                total = np.append(0, np.cumsum(x[at] * n)) if len(at) else np.zeros(1, np.int64)
                sums.append(pa.array(total[ends[1:]] - total[ends[:-1]]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *sums], names=[*batch.schema.names, "n_best", "count_sum"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, n_best long, count_sum long")


def align_tokenizers(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, keep_groups: bool = False) -> DataFrame:
    """Alignment of every document and the weight of its links in the corpus."""
    rows = cut_lineage(aligned(docs, path_a, path_b, keep_groups))
    return weighed(rows, pair_counts(rows))
