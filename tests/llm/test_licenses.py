from cases import with_clashes
from compare import connect, differences

from fleetwise.llm import licenses
from fleetwise.llm.queries import ORACLE_SQL, QUERIES

MIT, GPL, CC = (next(t for n, t in licenses.NOTICES if n == x) for x in ("MIT", "GPL-3.0", "CC-BY-NC-4.0"))
LONG_MIT = licenses.NOTICES[9][1]
FILES = [
    ("LICENSE", f"Some project.\n\n{LONG_MIT}\n\n" + "filler words here\n" * 40),
    ("a.py", "print(1)"),
    ("sub/b.py", None),
    ("sub/deep/COPYING", GPL),
    ("sub/deep/c.py", "# code\nx = 1\n"),
    ("sub/deep/er/d.py", f"# {CC}\n" + "code = 1\n" * 200),
    ("sub/deep/er/e.py", ""),
    ("other/notes.txt", MIT + " hello"),
    ("other/more.txt", "nothing of the kind"),
    ("other/more.txt", "nothing of the kind"),
    ("subdeep/f.py", "a sibling whose name begins alike"),
    ("LICENSEE.md", "text about a person"),
    (None, f"// {MIT}"),
    (None, "no path"),
    ("sub/licence.txt", "no licence text in it, the word license alone and other words"),
    ("x" * 3 + "/long.txt", "word " * 40_000 + "\n" + GPL + "\n" + "tail " * 1000),
]


def test_headers_files_and_inheritance(spark):
    files = with_clashes(spark.createDataFrame(FILES, "path string, text string"))
    got = [(r.path, r.licence, r.origin, r.licence_folder) for r in licenses.scan(files).collect()]
    want = [
        ("LICENSE", "MIT", "header", None), ("a.py", "MIT", "inherited", ""), ("sub/b.py", "MIT", "inherited", ""),
        ("sub/deep/COPYING", "GPL-3.0", "header", None), ("sub/deep/c.py", "GPL-3.0", "inherited", "sub/deep"),
        ("sub/deep/er/d.py", "CC-BY-NC-4.0", "header", None), ("sub/deep/er/e.py", "GPL-3.0", "inherited", "sub/deep"),
        ("other/notes.txt", "MIT", "header", None), ("other/more.txt", "MIT", "inherited", "other"), ("other/more.txt", "MIT", "inherited", "other"),
        ("subdeep/f.py", "MIT", "inherited", ""), ("LICENSEE.md", "MIT", "inherited", ""), (None, "MIT", "header", None), (None, None, None, None),
        ("sub/licence.txt", "MIT", "inherited", ""), ("xxx/long.txt", "GPL-3.0", "header", None),
    ]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_units_without_heavy_words_stay_below_the_threshold(spark):
    terms = licenses.templates(spark, licenses.NOTICES).collect()
    heavy = set(licenses.heavy_words(licenses.templates(spark, licenses.NOTICES), 0.75))
    for t in {r.template for r in terms}:
        assert sum(r.weight**2 for r in terms if r.template == t) > 0.999
        assert sum(r.weight**2 for r in terms if r.template == t and r.word not in heavy) < 0.75**2


def test_query_and_empty_table(spark, middle):
    ours = QUERIES["op8_license_scans"](spark, middle).toPandas()
    assert differences(ours, connect(middle).sql(ORACLE_SQL["op8_license_scans"]).df()) == []
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).collect() == []


def wrapped(text, mark, width=70):
    import textwrap

    return "\n".join(f"{mark}{line}" for line in textwrap.wrap(text, width))


def test_wrapped_headers_and_sentences_inside_a_paragraph(spark):
    whole = dict(licenses.WHOLE)
    code = "\nint main(void) { return compute(values, 17); }\n" * 30
    files = [
        *((f"{i}/{mark.strip() or 'plain'}.c", f"{mark}Copyright 2020 Some Person\n{mark.rstrip()}\n{wrapped(text, mark)}{code}", name)
          for i, (name, text) in enumerate(whole.items()) for mark in (" * ", "# ", "")),
        ("gpl/opening.py", wrapped(GPL, "# ", 60) + code, "GPL-3.0"),
        ("mit/opening.py", wrapped(licenses._GRANT, "// ", 60) + code, "MIT"),
        ("bsd/opening.py", wrapped(licenses._BSD, "# ", 50) + code, "BSD-3-Clause"),
        ("in/paragraph.md", "Read the guide of our tool before you begin, it has many pages. Licensed under the Apache License, Version 2.0. Questions go to the list, answers come from friends of the tool.", "Apache-2.0"),
        ("none/near.md", "the software license of this program and other words about permission, warranty, copies, conditions and use" + code, None),
    ]
    got = {r.path: (r.licence, r.origin) for r in licenses.scan(spark.createDataFrame([f[:2] for f in files], "path string, text string")).collect()}
    assert {p: got[p] for p, _, _ in files} == {p: (n, "header" if n else None) for p, _, n in files}
