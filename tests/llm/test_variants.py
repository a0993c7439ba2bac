import random
import re
import zlib
from collections import Counter

from cases import AWKWARD, documents

from fleetwise.llm import variants
from fleetwise.llm.variants import Variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def counted(rows, rule):
    out = Counter()
    for doc_id, text in rows:
        for w in RUN.findall(text or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if rule.typos and h % rule.typos == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= rule.length and n >= rule.occurrences}


def plainly(rows, rule):
    words = counted(rows, rule)
    forms, out = {}, {}
    for w, n in words.items():
        near = [v for v in words if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= rule.ratio * n else None
        out[w] = (len(near), n)
    rows = []
    for w, (near, n) in out.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.append((w, forms[w], root, n, near, words.get(forms[w])))
    return sorted(rows, key=repr)


def found(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=repr)


def corpus(seed, letters, docs=120, words=60, sizes=(3, 9)):
    rng = random.Random(seed)
    pool = ["".join(rng.choice(letters) for _ in range(rng.randrange(*sizes))) for _ in range(words)]
    pool += [w[:i] + rng.choice(letters) + w[i:] for w in pool[: words // 2] for i in (0, len(w) // 2)]
    pick = lambda: rng.choice(pool[: rng.randrange(1, len(pool) + 1)])  # noqa: E731  the first ones often
    return [(i, " ".join(pick() for _ in range(rng.randrange(40)))) for i in range(docs)]


def test_small_alphabets_meet_brute_force(spark):
    """Runs of equal letters, and words that are one edit apart in many ways."""
    for seed, letters in ((1, "ab"), (2, "aé"), (3, "abcÿ")):
        rows = corpus(seed, letters)
        for rule in (Variants(length=3, occurrences=2, ratio=2, typos=7), Variants(length=4, occurrences=1, ratio=3, typos=0)):
            assert found(variants.group_variants(documents(spark, rows), rule)) == plainly(rows, rule)


def test_default_rule_with_awkward_rows(spark):
    rows = [*AWKWARD, *corpus(5, "abcdefgh", docs=300, words=40, sizes=(6, 9)), (7, "x×y÷zab Ÿ ÿÿÿÿÿÿ")]
    assert found(variants.group_variants(documents(spark, rows))) == plainly(rows, Variants())
    # a letter beyond U+00FF ends a run, and nothing is cut out of it
    assert counted([(1, "ŁabcdefŁ " * 9)], Variants(typos=0)) == {"abcdef": 9}
    assert found(variants.group_variants(documents(spark, [(1, "ŁabcdefŁ " * 9)]), Variants(typos=0))) == [("abcdef", None, "abcdef", 9, 0, None)]


def test_forms_of_forms(spark):
    words = {"aaaaaa": 1000, "aaaaab": 150, "aaaabb": 25, "aaabbb": 5, "zzzzzz": 5, "zzzzzy": 5}
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(words.items())]
    got = {r.word: (r.form, r.root) for r in variants.group_variants(documents(spark, rows), Variants(typos=0)).collect()}
    assert got["aaabbb"] == ("aaaabb", "aaaaaa") and got["aaaaaa"] == (None, "aaaaaa")
    assert got["zzzzzz"] == (None, "zzzzzz")  # near, but not five times as frequent


def test_one_word_in_a_third_of_the_texts(spark):
    rows = [(i, "common commoner" if i % 3 == 0 else f"other{i} common") for i in range(3000)]
    got = {r.word: r.n for r in variants.group_variants(documents(spark, rows), Variants(typos=0)).collect()}
    assert got["common"] == 3000 and got["commoner"] == 1000


def test_handing_counts_on(spark, monkeypatch):
    rows = corpus(8, "abcdef", sizes=(6, 9))
    whole = sorted(map(tuple, variants.word_counts(documents(spark, rows)).collect()))
    assert dict(whole) == counted(rows, Variants())


def test_checksums_in_two_parts():
    import numpy as np

    for front, back in ((b"12:", b"word"), (b":", b"x" * 300), (b"-7:", b"")):
        whole = variants.crc_behind(np.array([zlib.crc32(front)], np.uint32), len(back))[0] ^ zlib.crc32(back)
        assert whole == zlib.crc32(front + back)


def test_empty_table(spark):
    assert variants.group_variants(documents(spark, [])).collect() == []
    assert variants.group_variants(documents(spark, [(1, None), (2, "")])).collect() == []
