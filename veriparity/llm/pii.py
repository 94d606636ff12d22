"""Personal data by anchor expansion.

One Aho-Corasick pass finds the anchors: at-signs, plus signs, digits, schemes
and the words that announce an identifier.  A deterministic parser per anchor
expands to the left and right, and validates what it has found.  Anchors that
lie inside the span found last for their kind are passed over, so the spans of
a kind are the leftmost ones and do not overlap.

Kinds ``email``, ``ip``, ``card`` and ``phone`` follow fixed patterns; ``url``
(scheme, host and path) and ``account`` (an identifier of 6 or more characters
with 4 or more digits behind an announcing word in any case, or a valid IBAN
anywhere) are added.  Overlapping spans of an identifier and an IBAN are joined.

Cases: a null or empty text has no spans; repeated rows are searched each; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import string

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from veriparity.llm.common import slices, texts_of

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE_KINDS = 4
CUES = ("account", "acct", "iban", "konto", "compte", "cuenta", "passport", "ssn")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL_REST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]+)?(?:[/?#][^\s<>\"']*)?")
SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
BEHIND_CUE = re.compile(r"(?i:[\s_-]?(?:number|num|no|nr|nummer|id))?[.\x20:#=_'\"]+")
GROUP = re.compile(r"[A-Za-z0-9]+")
BANK = re.compile(r"[A-Z]{4}")  # the one kind of group without a digit
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
# written in one piece or in groups of four
IBAN_WRITTEN = re.compile(
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:[-\x20][A-Z0-9]{4}){2,7}(?:[-\x20][A-Z0-9]{1,4})?)(?![A-Za-z0-9])"
)

LOWER = {ord(c): ord(c.lower()) for c in string.ascii_uppercase}  # keeps the places of characters

SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
    "found array<struct<kind:string,start:long,end:long>>"
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def email(text: str, at: int, last: int) -> tuple[int, int, bool] | None:
    start = at
    while start > last and text[start - 1] in LOCAL:
        start -= 1
    m = DOMAIN.match(text, at + 1) if start < at else None
    return (start, m.end(), True) if m else None


def ip(text: str, at: int, last: int) -> tuple[int, int, bool]:
    m = IP.match(text, at)
    if not m:  # then none starts at a later digit of this run either
        return at, DIGITS.match(text, at).end(), False
    return at, m.end(), all(len(p) < 4 and int(p or "0") < 256 for p in (x.lstrip("0") for x in m[0].split(".")))


def card(text: str, at: int, last: int) -> tuple[int, int, bool] | None:
    m = CARD.match(text, at)
    if not m:
        return None
    digits = only_digits(m[0])
    return at, m.end(), 13 <= len(digits) <= 19 and luhn(digits)


def phone(text: str, at: int, last: int) -> tuple[int, int, bool] | None:
    m = PHONE.match(text, at)
    return (at, m.end(), 9 <= len(only_digits(m[0])) <= 15) if m else None


def url(text: str, at: int, last: int) -> tuple[int, int, bool] | None:
    start = at
    while start > last and text[start - 1] in SCHEME:
        start -= 1
    m = URL_REST.match(text, at + 3)
    return (start, m.end(), text[start : start + 1].isalpha()) if m and start < at else None


def iban(compact: str) -> bool:
    return bool(IBAN.fullmatch(compact)) and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def ibans(text: str):
    """Spans of the valid IBANs, with or without an announcing word; groups that follow one do not belong to it."""
    at = 0
    while m := IBAN_WRITTEN.search(text, at):
        start, end, at = m.start(), m.end(), m.start() + 4
        while end > start + 4:
            if iban(text[start:end].replace(" ", "").replace("-", "")):
                yield start, end
                at = end
                break
            end = max(text.rfind(" ", start, end), text.rfind("-", start, end))


def joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Sorted spans, overlapping ones of a kind as one."""
    out: list[tuple[int, int, int]] = []
    for kind, start, end in sorted(spans):
        if out and out[-1][0] == kind and start < out[-1][2]:
            out[-1] = kind, out[-1][1], max(end, out[-1][2])
        else:
            out.append((kind, start, end))
    return out


def account(text: str, at: int, last: int) -> tuple[int, int, bool] | None:
    """The identifier behind an announcing word that ends at ``at``: groups with a blank or hyphen between two of them."""
    m = BEHIND_CUE.match(text, at)
    if not m:
        return None
    start = end = m.end()
    while (group := GROUP.match(text, end if end == start else end + 1)) and (DIGITS.search(group[0]) or BANK.fullmatch(group[0])):
        end = group.end()
        if text[end : end + 1] not in ("-", " "):
            break
    if end == start:
        return None
    found = text[start:end]
    compact = found.replace(" ", "").replace("-", "")
    valid = len(only_digits(found)) >= 4 and len(compact) >= 6
    if IBAN.fullmatch(compact):
        valid = iban(compact)
    return start, start + len(found), valid


PARSERS = {"@": ((0, email),), "+": ((3, phone),), "://": ((4, url),)} | {d: ((1, ip), (2, card)) for d in "0123456789"}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for anchor, parsers in PARSERS.items():
        found.add_word(anchor, (len(anchor) - 1, parsers))
    for cue in CUES:
        found.add_word(cue, (-1, ((5, account),)))
    found.make_automaton()
    return found


def personal_data(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end) of the valid spans, in order."""
    last = [0] * len(KINDS)
    spans = []
    for end, (back, parsers) in anchors.iter(text.translate(LOWER)):
        for kind, parse in parsers:
            at = end - back
            if at < last[kind]:
                continue
            found = parse(text, at, last[kind])
            if found:
                last[kind] = found[1]
                if found[2]:
                    spans.append((kind, found[0], found[1]))
    return joined(spans + [(KINDS.index("account"), *span) for span in ibans(text)])


def listed(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in spans)


NAMES = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "found"]
TYPES = [pa.int64()] * 5 + [pa.string()] * 2 + [
    pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
]


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts and digest of the four fixed kinds, and the spans of all kinds."""

    def run(batches):
        anchors = automaton()
        for part in slices(batches):
            out = []
            for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                spans = personal_data(text, anchors)
                base = [s for s in spans if s[0] < BASE_KINDS]
                n = [sum(s[0] == k for s in base) for k in range(BASE_KINDS)]
                out.append((doc_id, *n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans),
                            [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in spans]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)], names=NAMES
            )

    return texts_of(docs).mapInArrow(run, SCHEMA)
