"""Small tables that hold what real tables hold now and then."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

# Names that the operators use inside.
CLASH = "mark n k1 k2 prefix bins rep a b id cell words hashes score predicted worst train token_ids decoded n_words items size shard slot toxic block at marked units chars frames form output text_crc32 key edited first near best best_n start tie path shard".split()


def with_clashes(df):
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})


def documents(spark, rows):
    """``rows``: (doc_id, text). All other columns are there and mean nothing."""
    return with_clashes(spark.createDataFrame(rows, "doc_id bigint, text string"))


def sentence(rng: random.Random, n: int, words: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def edited(rng: random.Random, text: str, changes: int) -> str:
    words = text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


AWKWARD = [
    (None, "a text without an id that has a few words"),
    (None, None),
    (9001, None),
    (9002, ""),
    (9003, " \t\n "),
    (9004, "one"),
    (9005, "One"),
    (9006, "two words"),
    (9007, "ÄÖ ß é 中文 😀 naïve Ｘ"),
    (9008, "same row twice, same row twice, and then some more words"),
    (9008, "same row twice, same row twice, and then some more words"),
    (9009, "long " + "word " * 30_000 + "end"),
    (9010, "x" * 200_000),
    (9011, "nul \x00 byte and \x0b tab"),
]
