import random

import pytest
from cases import with_clashes

from fleetwise.llm import urls
from fleetwise.llm.queries import RULES


def table(spark, rows):
    return with_clashes(spark.createDataFrame(rows, "page_id bigint, url string"))


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return rest[:cut].translate(low), path[:end]


def ruled(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


CASES = [
    None, "", "no scheme", "http://", "://", "http://org", "http://org/", "HTTP://A.EXAMPLE.ORG/es/x", "https://example.org/en/12?x=/es/", "http://example.org/en/2",
    "http://notexample.org/es/", "http://xorg/", "http://a.com/fr/", "http://a.com/fr", "http://a.com/de/1#fr", "http://a.com?x=1/fr/", "http://a.com#/de/", "http://ÄB.com/fr/é",
    "http://a.com/x://b.org/", "ftp://u:p@a.com:80/de/", "http://a.com/fr/\nnew", "http://" + "a" * 50_000 + ".org/" + "b" * 50_000,
]


def test_hosts_paths_and_rules(spark):
    rows = list(enumerate(CASES)) + [(3, CASES[3]), (None, "http://a.org/x")]
    got = urls.judge(table(spark, rows), RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = plain("http://a.org/x" if r.page_id is None else CASES[r.page_id])
        rule, verdict = ruled(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def made(rng, good):
    words = ["garden", "library", "museum", "river", "school"] if good else ["casino", "jackpot", "pills", "bets", "freewin"]
    host = "-".join(rng.sample(words, 2))
    return f"{host}.example", f"/{rng.choice(words)}/{rng.randrange(1000)}"


def test_urls_without_a_rule_are_told_apart(spark):
    rng = random.Random(1)
    rules = [("allow", "good", "/"), ("block", "bad", "/")]
    rows, truth = [], {}
    for i in range(1200):
        good = rng.random() < 0.7
        host, path = made(rng, good)
        if i % 3:
            host += ".good" if good else ".bad"
        truth[i] = (good, bool(i % 3))
        rows.append((i, f"http://{host}{path}"))
    got = urls.judge(table(spark, rows), rules).collect()
    open_ = [(r.verdict == "allow") == truth[r.page_id][0] for r in got if not truth[r.page_id][1]]
    assert sum(open_) >= 0.97 * len(open_)


@pytest.mark.parametrize("rules", [[], [("allow", "org", "/")]])
def test_one_side_or_nothing_to_learn_from(spark, rules):
    got = urls.judge(table(spark, [(1, "http://a.org/"), (2, "http://b.net/")]), rules).collect()
    assert {r.verdict for r in got} == {"allow"}
    assert urls.judge(table(spark, []), rules).collect() == []


def test_same_as_counting_by_hand():
    import numpy as np
    import pyarrow as pa

    settings = urls.Settings(order=2, weight=1.0)
    counts = np.zeros((2, 2, 3, settings.cells), np.int64)
    for side, texts in enumerate((["abab", "abb"], ["ba"])):
        cells, _ = urls._cells(pa.array(texts), settings)
        for what in range(2):
            for k in range(3):
                counts[side, what, k] += np.bincount(cells[what, k], minlength=settings.cells)

    def log(texts, text):
        out, all_ = 0.0, ["^^" + t + "$" for t in texts]
        for i in range(2, len(text) + 3):
            framed = "^^" + text + "$"
            p = 1 / 257
            for k in range(3):
                context, run = framed[i - k : i], framed[i - k : i + 1]
                n = sum(t[j - k : j] == context for t in all_ for j in range(2, len(t)))
                c = sum(t[j - k : j + 1] == run for t in all_ for j in range(2, len(t)))
                p = (c + p) / (n + 1)
            out += np.log(p)
        return out

    for text in ("ab", "", "ba", "zz", "abab"):
        want = (log(["abab", "abb"], text) - log(["ba"], text)) / (len(text) + 1)
        assert urls._differences(pa.array([text]), counts, settings)[0] == pytest.approx(want)


def test_verdicts_are_those_of_exact_counts_on_many_varied_urls(spark):
    """Both ways to look values up, against counts in dictionaries."""
    from collections import Counter
    from math import log

    from pyspark.sql import functions as F

    rng = random.Random(5)
    syllables = [a + b for a in "bcdfgklmnprstvz" for b in "aeiou"]
    slug = lambda: "-".join("".join(rng.choices(syllables, k=3)) for _ in range(2))
    rules = [("allow", "good", "/"), ("block", "bad", "/")]
    made_ = [f"http://{slug()}.{rng.choice(['good', 'bad', 'bad', 'open'])}/{slug()}/{rng.getrandbits(48):x}" for _ in range(20_000)]
    pages = table(spark, list(enumerate(made_))).repartition(7)
    held = {r.page_id for r in pages.where(F.pmod(F.xxhash64("url"), F.lit(5)) == 0).select("page_id").collect()}
    seen, before = Counter(), Counter()
    framed = ["\0" * 5 + u + "\1" for u in made_]
    for i, u in enumerate(framed):
        side = 0 if ".good/" in u else 1 if ".bad/" in u else None
        if side is not None and i not in held:
            for j in range(5, len(u)):
                for k in range(6):
                    seen[side, u[j - k : j + 1]] += 1
                    before[side, u[j - k : j], k] += 1

    def difference(u):
        out = 0.0
        for j in range(5, len(u)):
            for side in range(2):
                p = 1 / 257
                for k in range(6):
                    p = (seen[side, u[j - k : j + 1]] + 4 * p) / (before[side, u[j - k : j], k] + 4)
                out += log(p) * (1 - 2 * side)
        return out / (len(u) - 5)

    verdicts = []
    for settings in (urls.Settings(), urls.Settings(table_rows=0)):
        got = {r.page_id: r for r in urls.judge(pages, rules, settings).collect()}
        assert len(got) == len(made_)
        for i in range(0, len(made_), 20):
            assert got[i].difference == pytest.approx(difference(framed[i]), abs=1e-9)
        verdicts.append([got[i].verdict for i in range(len(made_))])
    assert verdicts[0] == verdicts[1]
