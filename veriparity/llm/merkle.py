"""Document fingerprints: Merkle trees over sections, paragraphs and runs of words.

Paragraphs are the lines of a text.  Sections are runs of paragraphs that end
behind a paragraph whose hash says so.  The root is the hash of the section
hashes, a section's that of its paragraphs' hashes, so equal roots mean equal
texts.  Below the paragraphs lie leaves of a few words, cut behind words whose
hash says so.  All cuts depend on the words beside them alone: an edit changes
the leaves it touches and the nodes above them, and nothing else.

A fingerprint is ``root:leaves:leaf,leaf,...:word,word,...`` with the number of leaves, every leaf of the text as
``name.ends.bytes``, and the words of texts that have at most ``MAX_WORDS``.  ``ends`` tells whether a paragraph (1) or
a section (2) ends behind the leaf, so the nodes of paragraphs and sections follow from the leaves.  Two fingerprints
are compared by their words if both list them, else by the share of bytes in leaves that both hold; ``differing``
lists the byte ranges of the other leaves, paragraphs or sections, which locates edits.

Cases: a null or empty text has a tree without nodes; repeated rows get equal
fingerprints; an empty table gives an empty table; other columns are ignored.
Rows without doc_id come last, rows with equal doc_id in the order of their texts.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriparity.llm.common import Memo, slices, texts_of

LEAF_WORDS = 8  # expected words of a leaf
MAX_WORDS = 32
SECTION = 4  # expected paragraphs of a section
NO_ID = -(2**63)
LEAVES, PARAGRAPHS, SECTIONS = range(3)

WORD = re.compile(rb"[^ \t-\r]*[ \t-\r]+|[^ \t-\r]+")

Node = tuple[int, int, int]  # name, what ends behind it, bytes
Tree = tuple[str, list[Node], list[Node]]  # root, leaves, words


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def cut_words() -> Memo:
    """Tells the words behind which a leaf ends."""
    return Memo(lambda word: xxhash.xxh3_64_intdigest(word.rstrip()) % LEAF_WORDS == 0)


def paragraphs(text: bytes) -> list[bytes]:
    lines = text.split(b"\n")
    last = lines.pop()
    return [x + b"\n" for x in lines] + ([last] if last else [])


def leaves(paragraph: bytes, ends: Memo) -> tuple[bytes, list[Node]]:
    """Hash and leaves of a paragraph."""
    out, start, at = [], 0, 0
    for word in WORD.findall(paragraph):
        at += len(word)
        if ends[word]:
            out.append((xxhash.xxh3_64_intdigest(paragraph[start:at]), 0, at - start))
            start = at
    if start < at:
        out.append((xxhash.xxh3_64_intdigest(paragraph[start:at]), 0, at - start))
    name = digest(paragraph)
    last, _, size = out[-1]
    out[-1] = last, PARAGRAPHS if name[0] % SECTION else SECTIONS, size
    return name, out


def parents(nodes: list[Node], level: int) -> list[Node]:
    """Nodes that reach to the next end of that level."""
    out, names, size = [], b"", 0
    for name, ends, n in nodes:
        names += name.to_bytes(8, "big")
        size += n
        if ends >= level:
            out.append((xxhash.xxh3_64_intdigest(names), ends, size))
            names, size = b"", 0
    if names:
        out.append((xxhash.xxh3_64_intdigest(names), 0, size))
    return out


def tree(text: bytes, ends: Memo) -> Tree:
    nodes, root, section = [], hashlib.blake2b(digest_size=16), b""
    for paragraph in paragraphs(text):
        name, more = leaves(paragraph, ends)
        nodes += more
        section += name
        if name[0] % SECTION == 0:
            root.update(digest(section))
            section = b""
    root.update(digest(section))
    words = text.split() if len(text) < 32 * MAX_WORDS else ()
    words = [(xxhash.xxh3_64_intdigest(w) >> 32, 0, len(w)) for w in words] if len(words) <= MAX_WORDS else []
    return root.hexdigest(), nodes, words


def printed(t: Tree) -> str:
    root, nodes, words = t
    return f"{root}:{len(nodes)}:{written(nodes)}:{written(words)}"


def fingerprint(text: bytes, ends: Memo) -> str:
    return printed(tree(text, ends))


def written(nodes: list[Node]) -> str:
    return ",".join(["%x.%x.%x" % node for node in nodes])


def parsed(fp: str) -> Tree:
    root, _, *parts = fp.split(":")
    nodes, words = ([tuple(int(x, 16) for x in n.split(".")) for n in part.split(",") if n] for part in parts)
    return root, nodes, words


def likeness(a: str, b: str) -> float:
    """Shared bytes over all bytes of the nodes of both, from 0 to 1; 1 if the roots are equal."""
    return 1.0 if a.partition(":")[0] == b.partition(":")[0] else tree_likeness(parsed(a), parsed(b))


def tree_likeness(a: Tree, b: Tree) -> float:
    if a[0] == b[0]:
        return 1.0
    na, nb = (a[2], b[2]) if a[2] and b[2] else (a[1], b[1])
    left, every, shared = {}, 0, 0
    for name, _, n in na:
        left[name] = left.get(name, 0) + n
        every += n
    for name, _, n in nb:
        every += n
        if (there := left.get(name, 0)) > 0:
            both = min(there, n)
            left[name] = there - both
            shared += both
    every -= shared
    return shared / every if every else 0.0


def differing(a: str, b: str, level: int = LEAVES) -> list[tuple[int, int]]:
    """Byte ranges of the first text in leaves (or paragraphs, or sections) that the second one lacks."""
    (_, na, _), (_, nb, _) = parsed(a), parsed(b)
    if level:
        na, nb = parents(na, level), parents(nb, level)
    there, out, at = Counter(name for name, _, _ in nb), [], 0
    for name, _, n in na:
        if there[name]:
            there[name] -= 1
        elif out and out[-1][1] == at:
            out[-1] = out[-1][0], at + n
        else:
            out.append((at, at + n))
        at += n
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_chars`` and ``fingerprint`` of every row."""

    def run(batches):
        ends = cut_words()
        for part in slices(batches):
            texts = part["text"].to_pylist()
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array([len(x) for x in texts], pa.int64()),
                 pa.array([fingerprint(x.encode(), ends) for x in texts])],
                names=["doc_id", "n_chars", "fingerprint"],
            )

    return texts_of(docs).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def half_replaced(text: str, following: str) -> str:
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


EDITED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row and of its text with the last half replaced from the next row's.

    The next row is the one with the next smaller doc_id; the first row follows the last.  Rows are dealt
    into ranges of doc_id, one per partition; the row that follows a range, which is the first row of another,
    is sent along with it.  The ranges' borders (two numbers per partition) pass through the driver.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts_of(docs).select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("place"), "text")
    borders = sorted(
        (r["low"], r["high"])
        for r in rows.select("place").repartitionByRange(n, "place").groupBy(F.spark_partition_id())
        .agg(F.min("place").alias("low"), F.max("place").alias("high")).collect()
    )
    if not borders:
        return spark.createDataFrame([], EDITED)
    lows = np.array([low for low, _ in borders])
    after = {borders[(i - 1) % len(borders)][1]: i for i in range(len(borders))}  # first row of a range: the range before

    def deal(batches):
        for part in slices(batches):
            places = part["place"].to_numpy(zero_copy_only=False)
            ranges = (np.searchsorted(lows, places, side="right") - 1).astype(np.int32)
            follows = np.array([after.get(p, -1) for p in places.tolist()], np.int32)
            for to, keep, extra in ((ranges, slice(None), False), (follows, follows >= 0, True)):
                rows = np.arange(part.num_rows)[keep]
                if len(rows):
                    taken = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(to[keep]), pa.array([extra] * len(rows)), *taken.columns],
                        names=["range", "extra", *taken.schema.names],
                    )

    def compare(batches):
        ends, held, fp, whole = cut_words(), None, None, None
        done = False
        for part in slices(batches):
            out = []
            columns = (part[c].to_pylist() for c in ("extra", "doc_id", "text"))
            for extra, doc_id, text in zip(*columns, strict=True):
                if done:
                    continue
                mine = tree(text.encode(), ends)
                written_mine = None if extra else printed(mine)
                if held is not None:
                    edited = half_replaced(held[1], text)
                    data = edited.encode()
                    other = whole if edited == held[1] else tree(data, ends)
                    out.append((held[0], len(held[1]), hashlib.sha256(data).hexdigest(), fp, printed(other),
                                tree_likeness(whole, other), tree_likeness(whole, mine)))
                held, fp, whole, done = (doc_id, text), written_mine, mine, extra
            if out:
                types = [pa.int64()] * 2 + [pa.string()] * 3 + [pa.float64()] * 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=EDITED_NAMES
                )

    dealt = rows.mapInArrow(deal, "range int, extra boolean, doc_id long, place long, text string")
    return (
        dealt.repartitionById(len(borders), F.col("range"))
        .sortWithinPartitions("extra", F.desc("place"), "text")
        .select("extra", "doc_id", "text")
        .mapInArrow(compare, EDITED)
    )


EDITED_NAMES = [x.split()[0] for x in EDITED.split(", ")]
