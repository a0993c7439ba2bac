import hashlib
import random
import re

from cases import AWKWARD, documents

from fleetwise.llm import infill
from fleetwise.llm.infill import Infill

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def plainly(doc_id, text, rule=Infill()):
    """The same on whole strings: n, form, lengths, output."""
    text = text or ""
    units = TOKEN.findall(text)
    digest = hashlib.sha256(f"{rule.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m.decode() in text for m in rule.markers) or h[2] % 100 >= 100 - rule.plain:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < rule.suffix_first:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def mixed(rng, n):
    return "".join(rng.choice(["a", "Zz", "word", " ", "é", "日", "😀", "<", ">", "P", "\n", "\x00", "12"]) for _ in range(n))


def check(spark, rows, rule=Infill()):
    framed = infill.store(documents(spark, rows), rule)
    cut = infill.transform(framed, rule)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in infill.digests(cut, rule).collect()), key=repr)
    want = []
    for doc_id, text in rows:
        n, form, p, m, out = plainly(doc_id, text, rule)
        want.append((doc_id, n, form, p, m, sha(out), sha(text or "")))
    assert got == sorted(want, key=repr)
    return cut, framed


def test_awkward_and_mixed_texts(spark):
    rng = random.Random(4)
    rows = [*AWKWARD, *[(i, mixed(rng, rng.randrange(60))) for i in range(400)], (500, "a <M> b"), (501, "<P>"), (502, "<P <S")]
    cut, framed = check(spark, rows)
    texts = sorted(((r.doc_id, r.output) for r in infill.texts(cut).collect()), key=repr)
    assert texts == sorted(((i, plainly(i, t)[4]) for i, t in rows), key=repr)
    back = sorted(((r.doc_id, r.text) for r in infill.original(framed).collect()), key=repr)
    assert back == sorted(((i, t or "") for i, t in rows), key=repr)
    forms = {plainly(i, t)[1] for i, t in rows}
    assert forms == {"plain", "psm", "spm"}


def test_small_frames(spark, monkeypatch):
    """Cuts, letter runs, markers and characters that meet the ends of frames."""
    from fleetwise.llm import kernel

    rng = random.Random(5)
    rule = Infill(seed=9, plain=0, suffix_first=50)
    for size in (1, 2, 3, 7):
        rows = [(i, mixed(rng, rng.randrange(1, 40)) + "x" * rng.randrange(20)) for i in range(200)]
        monkeypatch.setattr(infill, "FRAME", size)
        assert kernel.SLICE_BYTES > 0
        for doc_id, text in rows:
            small = _one(doc_id, text, rule)
            n, form, p, m, out = plainly(doc_id, text, rule)
            assert small == (n, form, p, m, out, text), (size, doc_id, text)


def _one(doc_id, text, rule):
    """The operator's own steps on one document, outside Spark, so that the frame size can be set."""
    import numpy as np
    import zstandard

    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    point, unit = infill.unit_starts(data, np.zeros(1, np.int64))
    stops = infill._cuts(point, 0, len(raw))
    press, open_ = zstandard.ZstdCompressor().compress, zstandard.ZstdDecompressor().decompress
    frames = [press(raw[a:b]) for a, b in zip([0, *stops], stops)]  # noqa: B905
    units, chars = (np.append(0, np.cumsum(x))[stops] for x in (unit, point))
    doc = infill._Frames(units, chars, frames, open_)
    n = int(units[-1])
    marked = any(m in raw for m in rule.markers)
    form, a, b = rule.plan(doc_id, n, marked)
    if form == "plain":
        return n, form, None, None, text, text
    start, cut, end, stop = infill._Place(0, 0, 0), doc.place(a), doc.place(b), infill._Place(len(frames), 0, 0)
    parts = {"p": (rule.prefix, start, cut), "m": (rule.middle, cut, end), "s": (rule.suffix, end, stop)}
    out = []
    for name in form:
        marker, x, y = parts[name]
        out += [press(marker[:2]), press(marker[2:])]
        out += [piece if whole else press(piece) for whole, piece in doc.between(x, y)]
    output = b"".join(map(open_, out)).decode()
    back = b"".join(infill.restored(out, form, rule, open_)).decode()
    return n, form, cut.chars, end.chars - cut.chars, output, back


def test_long_text_of_many_frames(spark):
    rng = random.Random(6)
    rows = [(i, mixed(rng, 60_000).replace("<P>", "") + "q" * 150_000) for i in range(12)]
    check(spark, rows, Infill(plain=0))


def test_empty_table(spark):
    assert infill.digests(infill.transform(infill.store(documents(spark, [])))).collect() == []
