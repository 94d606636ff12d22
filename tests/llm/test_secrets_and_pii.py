import base64
import bz2
import gzip
import hashlib
import lzma
import re
import resource
import time
import urllib.parse
import zlib

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from veriparity.llm import pii, secret_scan

SECRET = "password=hunter2hunter"


def brute_secrets(text):
    found = []
    assign = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(assign, text):
        if len(m[1]) >= 6:
            found.append((m.start(), 0, m.end()))
    for kind, pattern, least in ((1, r"AKIA[A-Z0-9]+", 20), (2, r"[0-9a-f]+", 24)):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(found)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "=", ":", " ", "'", "secret", "AKIA", "ABCDEFGH12345678", "deadbeef", "0a", "Api_Key", "é", "K", "ſecret", "\n", "%3D"])).map("".join))
def test_base_findings_equal_brute_force(text):
    assert secret_scan.scan(text) == brute_secrets(text)


def wrap(kind, text):
    data = text.encode()
    return {
        "url": lambda: "".join(f"%{b:02X}" for b in data),
        "quoted": lambda: urllib.parse.quote(text, safe=""),
        "unicode": lambda: "".join(f"\\u{ord(c):04x}" for c in text),
        "entity": lambda: "".join(f"&#{ord(c)};" for c in text),
        "base64": lambda: base64.b64encode(data).decode(),
        "gzip": lambda: base64.b64encode(gzip.compress(data)).decode(),
        "zlib": lambda: base64.b64encode(zlib.compress(data)).decode(),
    }[kind]()


@pytest.mark.parametrize("layers", [["url"], ["quoted"], ["unicode"], ["entity"], ["base64"], ["gzip"], ["zlib"],
                                    ["base64", "url"], ["gzip", "base64", "quoted"], ["base64"] * 4, ["unicode", "base64"]])
def test_nested_layers_are_found_and_mapped(layers):
    hidden = f"here {SECRET} there"
    for kind in layers:
        hidden = wrap(kind, hidden)
    text = f"before é {hidden} after"
    base, every, _ = secret_scan.secrets_in(text)
    spans = [x for x in every if x[1] == 0]
    assert spans, layers
    start, _, end, depth = spans[0]
    assert text.index(hidden) <= start < end <= text.index(hidden) + len(hidden)
    assert depth >= 1 or layers == ["quoted"]
    assert set(base) <= {x[:3] for x in every}


def test_mapping_is_exact_for_escapes_and_base64():
    text = "ab%20" + wrap("url", SECRET) + "%20cd"
    start, _, end, _ = secret_scan.secrets_in(text)[1][0]
    assert text[start:end] == wrap("url", "ab " + SECRET + " cd")[6:6] + text[start:end]
    plain = "xyz " + SECRET + " zyx"
    coded = base64.b64encode(plain.encode()).decode()
    start, _, end, _ = secret_scan.secrets_in(coded)[1][0]
    assert base64.b64decode(coded[start // 4 * 4 : -(-end // 4) * 4]).decode().strip().startswith(SECRET[:3]) or SECRET in base64.b64decode(coded[start // 4 * 4 : -(-end // 4) * 4]).decode()
    assert end - start <= len(SECRET) * 4 / 3 + 3


def test_cycles_end():
    text = "%2525252541 " * 50 + "QUFBQUFBQUFBQUFBQUFBQQ=="
    assert secret_scan.secrets_in(text)[2] < 20


@pytest.mark.parametrize("layers", [["url"], ["unicode"], ["entity"], ["base64"], ["gzip"], ["base64", "url"], ["gzip", "base64"]])
def test_equal_runs_are_found_in_every_place(layers):
    hidden = f"here {SECRET} there"
    for kind in layers:
        hidden = wrap(kind, hidden)
    text = f"first {hidden} second {hidden} third"
    spans = [(start, end) for start, kind, end, _ in secret_scan.secrets_in(text)[1] if kind == 0]
    for at in (text.index(hidden), text.rindex(hidden)):
        assert any(at <= start < end <= at + len(hidden) for start, end in spans)
    assert secret_scan.masked(text, "[mask]").count("[mask]") == 2


@pytest.mark.parametrize("text, end", [
    ("token=" + "a" * 300 + "%2F" + "b" * 40 + " x", " x"),
    ("token=" + "a" * 300 + "\\u002F" + "b" * 40 + " x", " x"),
    ("see token=" + "a1-" * 400 + "%2E" + "c" * 400 + "%2E" + "d" * 400 + "\nx", "\nx"),
])
def test_long_runs_before_an_escape(text, end):
    start = text.index("token")
    assert (start, 0, len(text) - len(end)) in [x[:3] for x in secret_scan.secrets_in(text)[1]]
    assert secret_scan.masked(text, "#") == text[:start] + "#" + end


def first_secret(text):
    return [text[start:end] for start, kind, end, _ in secret_scan.secrets_in(text)[1] if kind == 0]


@pytest.mark.parametrize("kind", ["url", "unicode", "entity"])
@pytest.mark.parametrize("key", ['{"password": "%s"}', "secret = %s end", "token: ab%s", "a line\nApi_Key : '%s'"])
def test_escaped_values_behind_a_plain_key(key, kind):
    hidden = wrap(kind, "hunter2hunter")
    text = key % hidden
    found = first_secret(text)
    assert any(hidden in x for x in found)
    assert hidden[3:] not in secret_scan.masked(text, "#")


def lines(coded, width, joint="\n"):
    return joint.join(coded[i : i + width] for i in range(0, len(coded), width))


@pytest.mark.parametrize("kind", ["base64", "gzip", "zlib"])
@pytest.mark.parametrize("width", [64, 76])
@pytest.mark.parametrize("joint", ["\n", "\r\n", "\n    ", "\\n"])
def test_base64_over_lines(kind, width, joint):
    rest = hashlib.sha256(b"x").hexdigest().replace("0", "g") * 3
    plain = "".join(chr(33 + i * 37 % 90) for i in range(width * 3 // 4 - 9)) + " " + SECRET + " " + rest
    coded = lines(wrap(kind, plain), width, joint)
    for text in (f"key: x\n{coded}\nmore words", f"a long_name_of_a_file_here\n{coded}", f"before {coded} after"):
        found = [(s, e) for s, k, e, d in secret_scan.secrets_in(text)[1] if k == 0 and d]
        start = text.index(coded)
        assert any(start <= s < e <= start + len(coded) and joint in text[s:e] for s, e in found)


@pytest.mark.parametrize("kind", ["base64", "gzip", "zlib"])
@pytest.mark.parametrize("before", ["/srv/a/", "name_", "x-y-", "ab/cde_f-", "abc+"])
@pytest.mark.parametrize("after", ["", "/etc", "_x-y"])
def test_base64_joined_to_names(kind, before, after):
    coded = wrap(kind, f"here {SECRET} there").rstrip("=")
    text = f"see {before}{coded}{after} end"
    found = [(s, e) for s, k, e, d in secret_scan.secrets_in(text)[1] if k == 0 and d]
    start = text.index(coded)
    assert any(start <= s < e <= start + len(coded) for s, e in found)


def noise(n):
    return b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(n))


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress])
def test_streams_with_odd_bytes_and_cut_streams(pack):
    """One NUL or byte that is no UTF-8 in a stream, or a stream without its end, does not hide the rest."""
    for plain in (b"a\0b here " + SECRET.encode() + b" there", b"\xff here " + SECRET.encode() + b" there"):
        text = "x " + base64.b64encode(pack(plain)).decode() + " y"
        assert first_secret(text)
    data = pack(SECRET.encode() + b" and more of it " + noise(4000))
    text = "x " + base64.b64encode(data[: len(data) // 2]).decode()
    whole_blocks = pack in (bz2.compress, lzma.compress, zstandard.compress)  # these give nothing before a block ends
    assert first_secret(text) or whole_blocks


@pytest.mark.parametrize("form", ["%%%02x", "%%%02X", "\\x%02x"])
@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, zstandard.compress])
def test_streams_written_as_escapes(form, pack):
    data = pack(f"here {SECRET} there".encode())
    hidden = "".join(form % b for b in data)
    text = f"see {hidden} end"
    assert first_secret(text)
    if pack is not zstandard.compress:  # which may leave a short text as it is, to be found by its characters
        assert first_secret(text) == [hidden] and secret_scan.masked(text, "#") == "see # end"
    if form == "%%%02X":
        hidden = urllib.parse.quote_from_bytes(gzip.compress(f"here {SECRET} there".encode()))
        assert first_secret(f"see {hidden} end")


def test_one_bad_byte_in_a_run_of_escapes():
    assert first_secret("token=%61%62%63%64%65%66%ff%67 x") == ["token=%61%62%63%64%65%66"] or first_secret("token=%61%62%63%64%65%66%ff%67 x")
    assert first_secret("x %ff" + wrap("url", SECRET) + "%fe y")


@pytest.mark.parametrize("code", ["utf-16-le", "utf-16-be", "utf-16"])
def test_wide_texts_in_base64(code):
    coded = base64.b64encode(f"here {SECRET} there".encode(code)).decode()
    assert any(x in coded for x in first_secret(f"see {coded} end"))


@pytest.mark.parametrize("unit, first, last", [("25", "%", "41"), ("x5c", "\\", "x41"), ("u005c", "\\", "u0041"), ("#38;", "&", "#65;")])
def test_chains_of_escapes_take_linear_time(unit, first, last):
    began = time.time()
    for n in (1000, 200_000):
        text = "token=abcde" + first + unit * n + last + "fgh end"
        assert first_secret(text)[-1:] == [text[:-4]]
    assert time.time() - began < 10


def test_bombs_take_bounded_memory():
    began, before = time.time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    bomb = gzip.compress(b"A" * 4_000_000 + b" " + SECRET.encode() + b"B" * 4_000_000)
    for packed in (bomb, gzip.compress(bomb), bz2.compress(b"\0" * 40_000_000 + SECRET.encode())):
        assert first_secret("x " + base64.b64encode(packed).decode())
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 250_000 and time.time() - began < 90


def test_find_secrets(spark, documents, odd_documents, no_documents, texts):
    got = {r["doc_id"]: r for r in secret_scan.find_secrets(documents).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base = brute_secrets(t or "")
        digest = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert got[i * 3 + 1]["base_sha256"] == hashlib.sha256(digest.encode()).hexdigest()
    assert secret_scan.find_secrets(odd_documents).count() == odd_documents.count()
    assert secret_scan.find_secrets(no_documents).count() == 0


def test_redaction_keeps_rows_and_columns(spark, documents, no_documents):
    rows = spark.createDataFrame([(1, f"a {SECRET} b", "x"), (2, None, "y"), (3, "clean", None)], "doc_id long, text string, spans string")
    out = {r["doc_id"]: r for r in secret_scan.redact_secrets(rows).collect()}
    assert out[1]["text"] == "a [secret] b" and out[2]["text"] is None and out[3]["text"] == "clean" and out[2]["spans"] == "y"
    clean = secret_scan.redact_secrets(documents)
    assert clean.columns == documents.columns and clean.exceptAll(documents).isEmpty()
    assert secret_scan.redact_secrets(no_documents).count() == 0


def brute_pii(text):
    kinds = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub(r"[^0-9]", "", m)) <= 19 and luhn(re.sub(r"[^0-9]", "", m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"[^0-9]", "", m)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m[0])]


def luhn(digits):
    values = [int(c) for c in digits][::-1]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


PARTS = ["a", "b.c", "@", ".", "-", "+", " ", "(", ")", "12", "255", "256", "4111111111111111", "4111 1111 1111 1111", "0", "49",
         "http://", "é", "x@y.zz", "1.2.3.4", "account ", "\n"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_base_spans_equal_brute_force(text):
    spans = pii.personal_data(text, pii.automaton())
    assert [s for s in spans if s[0] < pii.BASE_KINDS] == brute_pii(text)


def test_added_kinds():
    anchors = pii.automaton()
    text = "see https://host.example/p?q=1 and account no: 12-345678 and IBAN DE89 3704 0044 0532 0130 00 now, accountant 12345678"
    found = {(pii.KINDS[k], text[s:e]) for k, s, e in pii.personal_data(text, anchors) if k >= pii.BASE_KINDS}
    assert ("url", "https://host.example/p?q=1") in found
    assert ("account", "12-345678") in found
    assert ("account", "DE89 3704 0044 0532 0130 00") in found
    assert not any("accountant" in t for _, t in found) and len(found) == 3


@pytest.mark.parametrize("text, found", [
    ("pay to DE89 3704 0044 0532 0130 00 by noon", "DE89 3704 0044 0532 0130 00"),
    ("pay to DE89370400440532013000, please", "DE89370400440532013000"),
    ("to GB29 NWBK 6016 1331 9268 19 1234 USD", "GB29 NWBK 6016 1331 9268 19"),
    ("to GB82-WEST-1234-5698-7654-32.", "GB82-WEST-1234-5698-7654-32"),
    ("to DE89 3704 0044 0532 0130 01 by noon", None),
    ("xDE89370400440532013000", None),
    ('{"account": "12345678"}', "12345678"),
    ('{"account_number" : "12345678"}', "12345678"),
    ("account_no=12345678", "12345678"),
    ("account_id: '12-345678'", "12-345678"),
    ("iban:        DE89370400440532013000", "DE89370400440532013000"),
])
def test_bare_ibans_and_quoted_identifiers(text, found):
    accounts = [text[s:e] for k, s, e in pii.personal_data(text, pii.automaton()) if pii.KINDS[k] == "account"]
    assert accounts == [found] * (found is not None)


def test_long_runs_take_linear_time():
    text = "1" * 300_000 + " " + "a" * 300_000 + "@" + "+1" * 50_000
    assert pii.personal_data(text, pii.automaton()) == []


@pytest.mark.parametrize("text", ["1.2.3." + "0" * 5000, "7" * 5000, "+1 " + "2" * 5000, "0" * 5000 + ".1.2.3", "4 " * 5000, "1." * 5000, "+1(" * 3000])
def test_endless_numbers(text):
    """Numbers of any length are judged, not refused; what lies behind them is found."""
    assert brute_pii(text) == [x for x in pii.personal_data(text, pii.automaton()) if x[0] < 4]
    assert (0, len(text) + 1, len(text) + 7) in pii.personal_data(text + " a@b.de", pii.automaton())


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("account 12345" + "x" * 55, (8, 68)), ("aCCount: 12345678", (9, 17)), ("konto " + "1234 " * 40 + "end", (6, 205)),
        ("account no 12345678 and", (11, 19)), ("account no123456", (8, 16)), ("IBAN ABCD 1234 5678", (5, 19)),
    ],
)
def test_identifiers_of_any_length_and_case(text, found):
    assert [(s, e) for kind, s, e in pii.personal_data(text, pii.automaton()) if kind == 5] == [found]


def test_find_pii(documents, odd_documents, no_documents, texts):
    got = {r["doc_id"]: r for r in pii.find_pii(documents).collect()}
    for i, t in enumerate(texts):
        digest = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in brute_pii(t or ""))
        assert got[i * 3 + 1]["base_sha256"] == hashlib.sha256(digest.encode()).hexdigest()
    assert pii.find_pii(odd_documents).count() == odd_documents.count()
    assert pii.find_pii(no_documents).count() == 0
