import hashlib

from veriparity.llm import merkle

TEXT = "\n".join(" ".join(f"w{i * j % 97}" for i in range(1, 30)) for j in range(1, 40))


def fp(text):
    return merkle.fingerprint(text.encode(), merkle.cut_words())


def test_equal_texts_have_equal_fingerprints_and_others_differ():
    assert fp(TEXT) == fp(TEXT)
    for other in (TEXT + " ", TEXT + "\n", TEXT.replace("w1 ", "w2 ", 1), TEXT[1:], ""):
        assert fp(other).split(":")[0] != fp(TEXT).split(":")[0]
        assert merkle.likeness(fp(other), fp(TEXT)) < 1
    assert merkle.likeness(fp(TEXT), fp(TEXT)) == 1 and merkle.likeness(fp(""), fp("")) == 1


def test_edits_are_located():
    edited = TEXT.replace("w5", "changed", 1)
    at = TEXT.encode().index(b"w5")
    ranges = merkle.differing(fp(TEXT), fp(edited))
    assert any(start <= at < end for start, end in ranges)
    assert sum(end - start for start, end in ranges) < len(TEXT) / 2
    assert merkle.likeness(fp(TEXT), fp(edited)) > 0.5


def test_insertions_shift_nothing():
    assert merkle.likeness(fp(TEXT), fp("A new first line.\n" + TEXT)) > 0.8


def test_texts_of_different_size_are_compared():
    long = "\n".join([TEXT.replace("w", f"v{i}") for i in range(30)])
    assert fp(long).split(":")[1] != fp(TEXT).split(":")[1]
    assert merkle.likeness(fp(long), fp(long + "\n" + TEXT)) > 0.7
    assert merkle.likeness(fp(long), fp(TEXT)) < 0.1


def long_text(joint):
    """20 000 words, and a copy with every fiftieth word changed."""
    words = [f"w{i * i % 7919}" for i in range(20_000)]
    changed = ["new" if i % 50 == 25 else w for i, w in enumerate(words)]
    return [joint.join(" ".join(x[i : i + 40]) for i in range(0, len(x), 40)) for x in (words, changed)]


def test_long_near_copies_are_alike():
    for joint in (" ", "\n"):
        text, changed = long_text(joint)
        # a word lies in a leaf of about 16 words, so 0.68 of the text is in equal leaves: 0.68 / 1.32 = 0.52
        assert 0.45 < merkle.likeness(fp(text), fp(changed)) < 0.6
        short = [" ".join(x.split()[:1000]) for x in (text, changed)]
        assert abs(merkle.likeness(*map(fp, short)) - merkle.likeness(fp(text), fp(changed))) < 0.15
        ranges = merkle.differing(fp(text), fp(changed))
        assert len(ranges) > 200 and sum(end - start for start, end in ranges) < len(text) / 2


def test_edits_in_long_texts_are_located_by_leaf_paragraph_and_section():
    text = long_text("\n")[0]
    lines = text.split("\n")
    lines[300] = lines[300][:50] + "X" + lines[300][51:]
    start = len("\n".join(lines[:300])) + 1
    end = start + len(lines[300]) + 1
    found = [merkle.differing(fp(text), fp("\n".join(lines)), level) for level in (merkle.LEAVES, merkle.PARAGRAPHS, merkle.SECTIONS)]
    assert found[1] == [(start, end)]
    (leaf,), (section,) = found[0], found[2]
    assert start <= leaf[0] <= start + 50 < leaf[1] <= end and leaf[1] - leaf[0] < end - start
    assert section[0] <= start and end <= section[1] and section[1] - section[0] < len(text) / 10


def brute(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for (doc_id, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        n = len(text) // 2
        edited = text[: len(text) - n] + following[:n]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), fp(text), fp(edited),
                    merkle.likeness(fp(text), fp(edited)), merkle.likeness(fp(text), fp(following))))
    return sorted(out, key=str)


def test_compare_with_next(spark, documents, odd_documents, no_documents, texts):
    got = sorted((tuple(r) for r in merkle.compare_with_next(documents).collect()), key=str)
    assert got == brute([(i * 3 + 1, t or "") for i, t in enumerate(texts)])
    odd = [(r["doc_id"], r["text"] or "") for r in odd_documents.collect()]
    assert sorted((tuple(r) for r in merkle.compare_with_next(odd_documents).collect()), key=str) == brute(odd)
    one = spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")
    assert merkle.compare_with_next(one).collect()[0]["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest()
    assert merkle.compare_with_next(no_documents).count() == 0


def test_fingerprints(documents, texts):
    got = {r["doc_id"]: r for r in merkle.fingerprints(documents).collect()}
    assert all(got[i * 3 + 1]["fingerprint"] == fp(t or "") and got[i * 3 + 1]["n_chars"] == len(t or "") for i, t in enumerate(texts))
