"""Packing of tokenised documents by shortest-pack-first over the length histogram.

1. Tokenise every document, add the end id and cut it into pieces: full
   sequences, and one remainder.  One map over the texts; ids need not move.
2. Count the remainders by length: a histogram of at most ``capacity`` cells.
3. Place lengths, longest first, into the packs with the least content so far
   that have room; equal packs are one pattern with a count, so the cost depends
   on the number of lengths, not of documents.  A pack is opened only when none
   has room, and takes as many pieces of its length as it holds.
4. Join patterns back to pieces by rank: pieces are range-partitioned by length
   and numbered within their partition; with the counts of earlier partitions
   (one number per partition and length at its ends) that is the rank among the
   pieces of a length.  A length that many pieces share spans many partitions.

Cases: a null or empty text is the end id alone; repeated rows are packed each;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import string
import zlib
from bisect import insort
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriparity.llm.common import Memo, as_bytes, slices, texts_of
from veriparity.session import cut_lineage

CAPACITY = 4096
END_ID = 2
MEMO_WORDS, MEMO_PARTS = 600_000, 150_000  # of a generation; a worker keeps two of each, some 300 MB
TOGETHER = 500  # words of letters encoded as one text
PUNCTUATION = string.punctuation.encode()
# fixed value: how a tokenizer file says that letters are one piece, digits alone and all other signs another
LETTERS_OR_OTHERS = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(1)
def loaded(path: str | None):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or default_tokenizer())


class WordTokens:
    """Ids of texts, put together from remembered ids of words.

    The tokenizer neither joins nor normalises across ASCII white space, which it drops, and lowers case, so the ids
    of a text are those of its words in a row; ``tests/llm`` hold this against encoding whole texts.  Words not
    remembered are encoded together, once for a slice of texts.  Where the tokenizer cuts between letters and
    punctuation, punctuation at the end of a word is remembered on its own, and words of letters, which end with one
    end-of-word token each, are encoded as one text.
    """

    def __init__(self, path: str | None):
        self.tokenizer = loaded(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        one = "Aa"  # a tokenizer that keeps case gets words as they are
        self.lowers = self.tokenizer.encode(one).ids == self.tokenizer.encode(one.lower()).ids
        told = json.loads(self.tokenizer.to_str())
        suffix = told["model"].get("end_of_word_suffix")
        self.cuts = bool(suffix) and LETTERS_OR_OTHERS in json.dumps(told["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts = Memo(lambda part: self.encoded([part])[0], MEMO_PARTS)
        self.memo = Memo(lambda word: self.packed([word])[0], MEMO_WORDS)

    def special(self, text: bytes) -> bool:
        """Whether the string of an added token stands in the text, which is neither cut nor lowered then."""
        return any(token in text for token in self.added)

    def packed(self, words: list[bytes]) -> list[bytes]:
        if not self.cuts:
            return self.encoded(words)
        pairs = []
        for word in words:
            core = word.rstrip(PUNCTUATION)
            # behind a letter only: other signs would be one piece with the punctuation
            if len(core) < len(word) and core and core.decode()[-1].lower()[-1:].isalpha() and not self.special(word):
                pairs.append((core, word[len(core) :]))
            else:
                pairs.append((word, b""))
        self.parts.fill({part for pair in pairs for part in pair if part}, self.encoded)
        get = self.parts.__getitem__
        return [get(core) + get(tail) if tail else get(core) for core, tail in pairs]

    def encoded(self, words: list[bytes]) -> list[bytes]:
        texts = [w.decode() for w in words]
        out: list = [None] * len(words)
        letters = [i for i, t in enumerate(texts) if self.cuts and t.lower().isalpha()]
        groups = [letters[i : i + TOGETHER] for i in range(0, len(letters), TOGETHER)]
        joined = self.tokenizer.encode_batch_fast([" ".join(texts[i] for i in g) for g in groups], add_special_tokens=False)
        for group, found in zip(groups, joined, strict=True):
            ids = np.array(found.ids, self.kind)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(group):  # else some word is in two pieces, and the group is encoded word by word
                data, at = ids.tobytes(), 0
                for i, stop in zip(group, (stops * ids.itemsize).tolist(), strict=True):
                    out[i] = data[at:stop]
                    at = stop
        rest = [i for i, found in enumerate(out) if found is None]
        for i, found in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(found.ids, self.kind).tobytes()
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        lowered = [x.lower() for x in texts] if self.lowers else texts
        words = [(x if low is not x and self.special(low) else low).split() for x, low in zip(texts, lowered, strict=True)]
        self.memo.fill(set().union(*words), self.packed)
        get = self.memo.__getitem__
        return [np.frombuffer(b"".join(map(get, x)), self.kind).astype(np.uint32) for x in words]


@lru_cache(1)
def word_tokens(path: str | None) -> WordTokens:
    """One memory per Python worker, which lives on from task to task."""
    return WordTokens(path)


PIECE = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


def pieces_of(docs: DataFrame, capacity: int, tokenizer: str | None, keep_ids: bool) -> DataFrame:
    """Every document's ids, the end id included, cut into pieces of ``capacity`` and a remainder."""

    def run(batches):
        tokens = word_tokens(tokenizer)
        for part in slices(batches):
            rows = defaultdict(list)
            encoded = tokens.encode(as_bytes(part["text"]))
            for doc_id, ids in zip(part["doc_id"].to_pylist(), encoded, strict=True):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    rows["doc_id"].append(doc_id)
                    rows["start"].append(start)
                    rows["length"].append(len(piece))
                    rows["ids_crc32"].append(zlib.crc32(piece.tobytes()))
                    rows["doc_tokens"].append(len(ids))
                    if keep_ids:
                        rows["ids"].append(piece.astype(np.int32))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(rows.values(), types, strict=False)], names=list(rows)
            )

    return texts_of(docs).mapInArrow(run, PIECE + ", ids array<int>" * keep_ids)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of a pack, longest first) and how many packs have each."""
    open_packs: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by room left
    rooms: list[int] = []

    def add(pattern: tuple[int, ...], count: int, room: int) -> None:
        if not open_packs[room]:
            insort(rooms, room)
        open_packs[room].append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if rooms and rooms[-1] >= length:  # the shortest pack has the most room
                room = rooms[-1]
                pattern, count = open_packs[room].pop()
                if not open_packs[room]:
                    rooms.pop()
                used = min(left, count)
                if used < count:
                    add(pattern, count - used, room)
                add((*pattern, length), used, room - length)
                left -= used
            else:
                each = min(left, capacity // length)
                packs = left // each
                add((length,) * each, packs, capacity - each * length)
                left -= packs * each
    return [x for room in sorted(open_packs) for x in open_packs[room]]


def slots_of(patterns, first: int) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset, tokens in the sequence) in the order of ranks."""
    taken: dict[int, int] = defaultdict(int)
    slots: dict[int, list] = defaultdict(list)
    for pattern, count in patterns:
        at, total = 0, sum(pattern)
        for length in pattern:
            slots[length].append((taken[length], first, at, total))
            taken[length] += count
            at += length
        first += count
    return {length: np.array(rows, np.int64) for length, rows in slots.items()}


PLACED = "sequence_id long, offset long, sequence_tokens int, padded_to int"


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, keep_ids: bool = True
) -> DataFrame:
    """One row per piece: where it comes from, its ids, and its place in a sequence.

    Sequences are to be padded to ``padded_to``: the capacity, or their own length if that is a power of two.
    ``tokenizer`` is the path of a tokenizer file that every executor can read.
    """
    spark = docs.sparkSession
    pieces = cut_lineage(pieces_of(docs, capacity, tokenizer, keep_ids))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def number(batches):
        """Position of a piece among those of its length in this partition."""
        from pyspark import TaskContext

        piece_range, length, seen = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            lengths = batch["length"].to_numpy()
            starts = np.flatnonzero(np.diff(lengths, prepend=length))
            head = int(starts[0]) if len(starts) else batch.num_rows  # rows that go on with the run before
            tail = np.arange(head, batch.num_rows) - np.repeat(starts, np.diff(np.append(starts, batch.num_rows)))
            nth = np.concatenate([np.arange(head) + seen, tail])
            length, seen = int(lengths[-1]) if batch.num_rows else length, int(nth[-1]) + 1 if batch.num_rows else seen
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([piece_range] * batch.num_rows, pa.int32()), pa.array(nth, pa.int64())],
                names=[*batch.schema.names, "range", "nth"],
            )

    slim = pieces.drop("ids")
    numbered = cut_lineage(
        slim.withColumn("h", F.xxhash64("doc_id", "start", "ids_crc32")).repartitionByRange(n, "length", "h").drop("h")
        .sortWithinPartitions("length").mapInArrow(number, PIECE + ", range int, nth long")
    )
    # at most one row per partition and length at its ends: fewer than partitions + capacity
    counts = sorted(tuple(r) for r in numbered.groupBy("length", "range").count().collect())
    histogram: dict[int, int] = defaultdict(int)
    before: dict[tuple[int, int], int] = {}
    for length, piece_range, count in counts:
        before[length, piece_range] = histogram[length]
        histogram[length] += count
    full = histogram.pop(capacity, 0)
    slots = slots_of(shortest_pack_first(histogram, capacity), full)
    slots[capacity] = np.array([(0, 0, 0, capacity)], np.int64)
    sent = spark.sparkContext.broadcast((before, slots))

    def place(batches):
        before, slots = sent.value
        for batch in batches:
            lengths = batch["length"].to_numpy()
            ranges = batch["range"].to_numpy()
            rank = batch["nth"].to_numpy() + np.array(
                [before[x] for x in zip(lengths.tolist(), ranges.tolist(), strict=True)], np.int64
            )
            out = np.zeros((batch.num_rows, 3), np.int64)
            for length in np.unique(lengths):
                mine, rows = lengths == length, slots[int(length)]
                slot = rows[np.searchsorted(rows[:, 0], rank[mine], side="right") - 1]
                out[mine] = np.stack([slot[:, 1] + rank[mine] - slot[:, 0], slot[:, 2], slot[:, 3]], axis=1)
            total = out[:, 2].astype(np.int32)
            padded = np.where(total & (total - 1), np.int32(capacity), total)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], *(pa.array(x) for x in (out[:, 0], out[:, 1], total, padded))],
                names=[*batch.schema.names[:5], *(x.split()[0] for x in PLACED.split(", "))],
            )

    placed = numbered.mapInArrow(place, f"{PIECE}, {PLACED}")
    if not keep_ids:
        return placed
    key = [F.xxhash64("doc_id", "doc_tokens", "start", "ids_crc32").alias("k")]
    ids = pieces.select(*key, "ids").groupBy("k").agg(F.first("ids").alias("ids"))  # equal pieces hold equal ids
    return placed.withColumn("k", key[0]).join(ids, "k").drop("k")


def sequences_of(packed: DataFrame) -> DataFrame:
    """Ids of each sequence, at most the capacity of them; ``doc_ids`` tells whose they are, piece by piece."""
    rows = packed.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("p"),
        F.first("padded_to").alias("padded_to"),
    )
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), "padded_to")
