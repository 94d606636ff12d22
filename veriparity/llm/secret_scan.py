"""Secret scan by a recursive decoding worklist.

The whole text is layer 0.  Every layer is scanned by the same three patterns;
then its URL escapes and its Unicode escapes are decoded in place, each kind
into a layer that is whole but for them, so that a key and its escaped value stay
together, and each base64 run, alone and with the lines it goes on in, is decoded
from each of its four phases (a path or a name may stand before the coded part)
into layers of the readable stretches and of the compressed streams.  The worklist runs until no new layer appears; a layer with the content and
the place of an earlier one is dropped, which ends cycles, while equal runs in
other places have layers of their own.  Every character of a layer knows
the span of the original text it came from, so a finding in any layer is
reported as a span of the original, in code points.

Streams are inflated a piece at a time, as far as they are sound, and so are streams written as escapes;
what they hold came, as a whole, from where they stand.  A stretch of theirs of more than two megabytes is
searched in parts that overlap.  An escape of the character that begins the next escape is decoded with it, so
chains of them are one layer; escapes that take turns in such a chain are a layer each.

Cases: a null or empty text has no spans; repeated rows are scanned each; an
empty table gives an empty table; other columns are ignored by ``find_secrets``
and carried unchanged by ``redact_secrets``.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import urllib.parse
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from veriparity.llm.common import slices, texts_of

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the greedy run is the whole run, so the least length can be asked at once
ASSIGN_MIN, ACCESS_MIN = 6, 20

# an escape that stands for the first character of the next one belongs to it, so chains of them are decoded at once
URL_UNIT = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
URL_ESCAPE = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+")
UNICODE_ESCAPE = re.compile(
    r"\\(?:x5[cC]|u005[cC])*(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2}))|&(?:#38;|#[xX]26;)*#(?:([0-9]{1,7})|[xX]([0-9A-Fa-f]{1,6}));"
)
# bytes written as escapes, with the characters that need none; %1f%8b and the like stand in them as streams
URL_BYTES = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~!*'()+,;:@/?=&$-])+")
HIGH_BYTE = re.compile(r"%[89A-Fa-f][0-9A-Fa-f]")
HEX_BYTES = re.compile(r"(?:\\x[0-9A-Fa-f]{2}){6,}")
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
BASE64_NEXT = re.compile(r"[ \t]*(?:\r\n?|\n|(?:\\r)?\\n)[ \t>|#*]*([A-Za-z0-9+/_-]+)")
BASE64_START = re.compile(r"[+/_-]")  # a coded part may begin behind it
ALPHABET = str.maketrans("-_", "+/")
PLAIN = rb"[\t\n\r\x20-\x7e]"
LONGER = (
    rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}"
    rb"|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
)
# UTF-8 of 12 characters, the least that a finding or a further layer has
READABLE = re.compile(rb"(?=(?:" + PLAIN + rb"|" + LONGER + rb"){12})(?:" + PLAIN + rb"++|" + LONGER + rb")++")
WIDE = tuple(re.compile(rb"(?:" + pair + rb"){12,}") for pair in (rb"[\t\n\r\x20-\x7e]\x00", rb"\x00[\t\n\r\x20-\x7e]"))
MAGIC = ((b"\x1f\x8b", lambda: zlib.decompressobj(31)), (b"BZh", bz2.BZ2Decompressor), (b"\xfd7zXZ", lzma.LZMADecompressor),
         (b"\x28\xb5\x2f\xfd", lambda: zstandard.ZstdDecompressor().decompressobj()))
HEADS = {magic[:2] for magic, _ in MAGIC}
BROKEN = (OSError, EOFError, zlib.error, lzma.LZMAError, zstandard.ZstdError, ValueError)
INFLATE = type(zlib.decompressobj())
HEAD, PIECE, FEED, OVERLAP = 1 << 16, 1 << 20, 256, 1 << 16
LONG_BLANKS = re.compile(rb" {65,}")

SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, n_layers long, base_sha256 string, spans string, "
    "found array<struct<kind:string,start:long,end:long,layer:int>>"
)


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the findings in one layer, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A decoded text; character i came from [lo[i], hi[i]) of the original text."""

    __slots__ = ("text", "lo", "hi", "depth")

    def __init__(self, text, lo=None, hi=None, depth=0):
        self.text, self.lo, self.hi, self.depth = text, lo, hi, depth

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.lo is None:
            return start, end
        return int(self.lo[start:end].min()), int(self.hi[start:end].max())

    def borders(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        if self.lo is None:
            lo = np.arange(start, end, dtype=np.int32)
            return lo, lo + 1
        return self.lo[start:end], self.hi[start:end]

    def key(self) -> bytes:
        """Tells layers apart that differ in their text or in the places of its characters."""
        lo, hi = self.borders(0, len(self.text))
        found = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16)
        for places in (lo, hi):
            found.update(np.ascontiguousarray(places, np.int32))
        return found.digest()


def begins_stream(data: bytes, at: int = 0) -> bool:
    head = data[at : at + 2]
    return head in HEADS or len(head) == 2 and head[0] & 0x0F == 8 and (head[0] << 8 | head[1]) % 31 == 0


def fed(one, data: bytes):
    """What a decoder gives for some input, at most ``PIECE`` bytes at a time where the decoder can be told so."""
    if isinstance(one, (bz2.BZ2Decompressor, lzma.LZMADecompressor)):
        yield one.decompress(data, PIECE)
        while not one.eof and not one.needs_input:
            yield one.decompress(b"", PIECE)
    elif isinstance(one, INFLATE):
        yield one.decompress(data, PIECE)
        while not one.eof and one.unconsumed_tail:
            yield one.decompress(one.unconsumed_tail, PIECE)
    else:  # a decoder without a limit: little input at a time bounds what it gives
        yield one.decompress(data)


def expanded(chunks, used: list[int]):
    """Pieces of what the compressed streams hold that some bytes begin with, as far as they are sound.

    The number of bytes that the streams take is added to ``used``.
    """
    chunks = iter(chunks)
    held = next(chunks, b"")
    while len(held) < 6 and (more := next(chunks, b"")):
        held += more
    kind = next((k for k in (*MAGIC, (b"", zlib.decompressobj)) if held.startswith(k[0])), None)
    while kind is not None and begins_stream(held) and held.startswith(kind[0]):
        one = kind[1]()
        try:
            while not one.eof:
                at = 0
                while at < len(held) and not one.eof:
                    yield from fed(one, held[at : at + FEED])
                    at += FEED
                used[0] += min(at, len(held))
                held = held[at:]
                if not one.eof and not (held := next(chunks, b"")):
                    return  # cut short: what there was has been given
        except BROKEN:
            return
        used[0] -= len(one.unused_data)
        held = one.unused_data + held
        while len(held) < 6 and (more := next(chunks, b"")):
            held += more
        if not kind[0]:
            return


def contents(data: bytes, used: list[int]):
    """Pieces of the innermost content of nested streams; a stream that begins like one around it ends a cycle."""
    pieces, seen = expanded([data], used), {hashlib.sha256(data[:HEAD]).digest()}
    while True:
        head = b""
        while len(head) < HEAD and (piece := next(pieces, None)) is not None:
            head += piece
        mark = hashlib.sha256(head[:HEAD]).digest()
        pieces = chain([head], pieces)
        if not begins_stream(head) or mark in seen:
            return pieces
        seen.add(mark)
        inner = expanded(pieces, [0])
        first = next(inner, b"")
        if not first:
            return iter([head])
        pieces = chain([first], inner)


def of_size(pieces, size: int):
    """The same bytes in pieces of ``size`` at least, but for the last."""
    some, total = [], 0
    for piece in pieces:
        some.append(piece)
        total += len(piece)
        if total >= size:
            yield b"".join(some)
            some, total = [], 0
    yield b"".join(some)


def stretches(pieces):
    """Readable texts in bytes that come in pieces.

    One that reaches over a piece is held until it ends; from ``2 * PIECE`` on it is given in parts that overlap by
    ``OVERLAP`` characters, with runs of blanks, which may part a key from its value, made short.
    """
    held = b""
    for piece in of_size(pieces, PIECE):
        held = LONG_BLANKS.sub(b" " * 64, held + piece)
        open_from = len(held)
        for m in READABLE.finditer(held):
            if m.end() < len(held) - 3:
                yield m[0].decode()
            elif len(m[0]) > 2 * PIECE:
                yield m[0].decode()
                open_from = m.end() - OVERLAP
                while held[open_from] & 0xC0 == 0x80:
                    open_from += 1
            else:
                open_from = m.start()
        held = held[min(open_from, max(len(held) - 64, 0)) if open_from == len(held) else open_from :]
    for m in READABLE.finditer(held):
        yield m[0].decode()


def inflated(data: bytes, lo: int, hi_of, depth: int):
    """Layers of the streams that some bytes begin with; all they hold came from where the streams stand."""
    used = [0]
    if not sum(map(len, expanded([data], used))):  # a first pass, for where the streams end
        return
    hi = hi_of(used[0])
    for text in stretches(contents(data, [0])):
        yield Layer(text, np.full(len(text), lo, np.int32), np.full(len(text), hi, np.int32), depth)


def replaced(layer: Layer, escape: re.Pattern, decode) -> Layer | None:
    """The whole layer with its escapes decoded."""
    text, parts, starts, ends, widths, at = layer.text, [], [], [], [], 0
    for m in escape.finditer(text):
        part = decode(m)
        if part is None:
            continue
        parts += [text[at : m.start()], part]
        at = m.end()
        starts.append(m.start())
        ends.append(at)
        widths.append(len(part))
    if not at:
        return None
    edge = np.zeros(len(text) + 1, np.int32)
    edge[starts] += 1
    edge[ends] -= 1
    repeats = 1 - np.cumsum(edge)[:-1]  # 0 inside escapes
    repeats[starts] = widths
    last = np.arange(len(text), dtype=np.int32)
    last[starts] = np.array(ends) - 1
    first = np.repeat(np.arange(len(text), dtype=np.int32), repeats)
    lo, hi = layer.borders(0, len(text))
    return Layer("".join(parts) + text[at:], lo[first], hi[last[first]], layer.depth + 1)


def percent(m: re.Match) -> str | None:
    """The valid UTF-8 of a run of URL escapes; bytes that are none stay escapes."""
    data = bytes.fromhex("".join(URL_UNIT.findall(m[0])))
    text = data.decode("utf-8", "surrogateescape")
    if text.isprintable() or not any("\udc80" <= c <= "\udcff" for c in text):
        return text
    kept = "".join(f"%{ord(c) - 0xDC00:02X}" if "\udc80" <= c <= "\udcff" else c for c in text)
    return kept if any(not "\udc80" <= c <= "\udcff" for c in text) else None


def escaped(m: re.Match) -> str | None:
    code = int(m[1] or m[2] or m[4] or "0", 16) if m[3] is None else int(m[3])
    return chr(code) if code < 0xD800 or 0xE000 <= code < 0x110000 else None


def chains(text: str):
    """Spans of base64 text: every run alone, then runs with the lines of base64 that follow.

    Lines go on while they are no shorter than the one before; only the first may be shorter than the second,
    as text may stand before it.
    """
    past = 0
    for m in BASE64_RUN.finditer(text):
        yield [m.span()]
        if m.start() < past or text[m.end() - 1] == "=":
            continue
        spans = [m.span()]
        while more := BASE64_NEXT.match(text, spans[-1][1]):
            size, before = more.end(1) - more.start(1), spans[-1][1] - spans[-1][0]
            if len(spans) > 1 and size > before:
                break
            spans.append(more.span(1))
            if size < before:
                break
        if len(spans) > 1:
            past = spans[-1][0]  # the last line may be the first one of another width
            yield spans


def unpacked(layer: Layer, spans: list[tuple[int, int]]):
    """Layers of the readable stretches of a base64 text and of the compressed streams in it."""
    runs = [layer.text[start:end].rstrip("=").translate(ALPHABET) for start, end in spans]
    body, borders = "".join(runs), []

    def origin() -> tuple[np.ndarray, np.ndarray]:
        if not borders:
            sides = [layer.borders(start, start + len(run)) for (start, _), run in zip(spans, runs, strict=True)]
            borders.extend(np.concatenate(x) for x in zip(*sides, strict=True))
            borders[1][-1] = layer.borders(spans[-1][0], spans[-1][1])[1][-1]  # the padding belongs to the last
        return borders

    begins = {0, *(m.end() for m in BASE64_START.finditer(body)), *np.cumsum([len(x) for x in runs[:-1]]).tolist()}
    for phase in range(4):
        coded = body[phase:]
        coded = coded[: len(coded) - (len(coded) % 4 == 1)]
        data = binascii.a2b_base64(coded + "=" * (-len(coded) % 4))
        for m in READABLE.finditer(data):
            text = m[0].decode()
            widths = np.array([len(c.encode()) for c in text])
            first = m.start() + np.cumsum(widths) - widths
            lo, hi = origin()
            at_hi = phase + ((first + widths - 1) * 8 + 7) // 6
            yield Layer(text, lo[phase + first * 8 // 6], hi[np.minimum(at_hi, len(body) - 1)], layer.depth + 1)
        for pattern in WIDE:
            for m in pattern.finditer(data):
                text = m[0].replace(b"\0", b"").decode()
                first = m.start() + 2 * np.arange(len(text))
                lo, hi = origin()
                yield Layer(text, lo[phase + first * 8 // 6], hi[np.minimum(phase + ((first + 1) * 8 + 7) // 6, len(body) - 1)], layer.depth + 1)
        for begin in sorted(x for x in begins if x % 4 == phase):
            at = (begin - phase) // 4 * 3
            if begins_stream(data, at):
                lo, hi = origin()
                end = lambda used, at=at, hi=hi, phase=phase: hi[min(phase + ((at + used - 1) * 8 + 7) // 6, len(body) - 1)]
                yield from inflated(data[at:], lo[begin], end, layer.depth + 1)


def escaped_streams(layer: Layer):
    """Layers of compressed streams that are written as URL escapes or ``\\x`` escapes."""
    kinds = [URL_BYTES] * bool(HIGH_BYTE.search(layer.text)) + [HEX_BYTES]
    for pattern in kinds:
        for m in pattern.finditer(layer.text):
            if pattern is URL_BYTES and not HIGH_BYTE.search(m[0]):
                continue
            data = urllib.parse.unquote_to_bytes(m[0]) if m[0][0] != "\\" else bytes.fromhex(m[0].replace("\\x", ""))
            starts = {0} if begins_stream(data) else set()
            for magic, _ in MAGIC:
                at = -1
                while (at := data.find(magic, at + 1)) >= 0:
                    starts.add(at)
            for at in sorted(starts):
                lo, hi = layer.origin(m.start(), m.end())
                yield from inflated(data[at:], lo, lambda used, hi=hi: hi, layer.depth + 1)


def unwrapped(layer: Layer):
    """Every layer that lies one decoding step below."""
    text = layer.text
    if "%" in text or "\\x" in text:
        yield from escaped_streams(layer)
    if "%" in text:
        yield replaced(layer, URL_ESCAPE, percent)
    if "\\" in text or "&#" in text:
        yield replaced(layer, UNICODE_ESCAPE, escaped)
    for spans in chains(text):
        yield from unpacked(layer, spans)


def secrets_in(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]], int]:
    """Findings of layer 0, findings of all layers with the depth of the first, and the number of layers."""
    base = scan(text)
    every = {x: 0 for x in base}
    work = [Layer(text)]
    seen = {work[0].key()}
    while work:
        layer = work.pop()
        for below in unwrapped(layer):
            if below is None or (key := below.key()) in seen:
                continue
            seen.add(key)
            work.append(below)
            for start, kind, end in scan(below.text):
                lo, hi = below.origin(start, end)
                every.setdefault((lo, kind, hi), below.depth)
    return base, sorted((*span, depth) for span, depth in every.items()), len(seen)


def listed(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end, *_ in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts and digest of the findings in the plain text, and all findings.

    ``found`` holds every finding as a struct, ``spans`` the same as text.
    """

    def run(batches):
        for part in slices(batches):
            out = []
            for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                base, every, layers = secrets_in(text)
                n = [sum(kind == k for _, kind, _ in base) for k in range(3)]
                out.append((doc_id, *n, layers, hashlib.sha256(listed(base).encode()).hexdigest(), listed(every),
                            [{"kind": KINDS[k], "start": s, "end": e, "layer": d} for s, k, e, d in every]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)], names=NAMES
            )

    return texts_of(docs).mapInArrow(run, SCHEMA)


NAMES = ["doc_id", "n_assign", "n_access", "n_hex", "n_layers", "base_sha256", "spans", "found"]
TYPES = [pa.int64()] * 5 + [pa.string()] * 2 + [
    pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("layer", pa.int32())]))
]


def masked(text: str, mask: str) -> str:
    """The text with every finding, overlapping ones merged, replaced by the mask."""
    out, at = [], 0
    for start, _, end, _ in secrets_in(text)[1]:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` with findings masked in ``text``; null texts stay null, other columns are unchanged."""
    schema = docs.schema

    def run(batches):
        for part in slices(batches):
            i = part.schema.get_field_index("text")
            clean = [x if x is None else masked(x, mask) for x in part.column(i).to_pylist()]
            yield part.set_column(i, part.schema.field(i), pa.array(clean, part.schema.field(i).type))

    return docs.mapInArrow(run, schema)
