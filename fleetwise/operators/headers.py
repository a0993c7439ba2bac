"""Matching the column headers of user files to signals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetwise.functions.scalars import plain_name
from fleetwise.shared import stored
from fleetwise.spec import DEFAULT, TelemetrySpec

# Other names of each signal, in plain form, and the match scores.
SYNONYMS = {
    "engine_speed_rpm": ("rpm", "enginerpm", "enginespeed", "speedrpm", "revs", "rev", "n"),
    "coolant_temp_c": (
        "coolant", "coolanttemp", "coolanttemperature", "watertemp", "ect", "coolantc",
    ),
    "oil_pressure_kpa": ("oilpressure", "oilpress", "oilp", "oil", "oilpsi"),
    "engine_load_pct": ("engineload", "load", "loadpct", "torquepct", "loadpercent"),
    "fuel_rate_lph": ("fuelrate", "fuel", "fuelconsumption", "fuellph", "fuelflow"),
    "boost_pressure_kpa": (
        "boost", "boostpressure", "manifoldpressure", "map", "turboboost", "boostkpa",
    ),
    "egt_c": ("egt", "exhausttemp", "exhaustgastemp", "exhaust", "exhausttemperature"),
    "def_level_pct": ("def", "deflevel", "adblue", "urea", "defpct", "defpercent"),
    "vibration_mms": ("vibration", "vib", "vibrationlevel", "vibmms", "vibe"),
}
EXACT, SYNONYM, CUT = 1.0, 0.95, 0.6


def edit_similarity(a: Column, b: Column) -> Column:
    """1 minus the edit distance over the longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1.0 - F.levenshtein(a, b) / longest.cast("double")).otherwise(0.0)


def matching_ratio(at_least: float = 0.0):
    """Twice the matched characters over both lengths, matched longest block first.

    A pair whose upper bound stays below ``at_least`` gets 0 without being matched.
    """

    @F.pandas_udf("double")
    def ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        matcher, held = SequenceMatcher(None, autojunk=False), None
        for signals, names in batches:
            out = []
            for signal, name in zip(signals, names):
                if name != held:  # the matcher keeps an index of its second text
                    matcher.set_seq2(name)
                    held = name
                matcher.set_seq1(signal)
                hopeless = matcher.quick_ratio() < at_least
                out.append(0.0 if hopeless else matcher.ratio())
            yield pd.Series(out, dtype="float64")

    return ratio


def pair_scores(
    headers: DataFrame,
    header: str,
    spec: TelemetrySpec = DEFAULT,
    *,
    ratio: str = "edit",
    at_least: float = 0.0,
) -> DataFrame:
    """(header, signal, score) of every distinct header with every signal.

    Distinct plain names are scored once, however many files use them. ``ratio`` is "edit", the
    default, or "matching", which calls Python once per pair. Pairs under
    ``at_least`` may be left out or given as 0, which spares most of the work.
    """
    # written, so that the files are read once and plain names are made of distinct headers only
    names = stored(headers.select(F.col(header).alias("header")).distinct(), "headers")
    plain = names.withColumn("_name", plain_name(F.col("header")))
    signals = F.array(
        *[
            F.struct(
                F.lit(s).alias("signal"),
                plain_name(F.lit(s)).alias("_signal"),
                F.array(*[F.lit(w) for w in SYNONYMS.get(s, ())]).cast("array<string>").alias("_words"),
            )
            for s in spec.signals
        ]
    )
    distinct = plain.select("_name").distinct().select("_name", F.inline(signals))
    known = (
        F.when(F.col("_name") == "", 0.0)
        .when(F.col("_name") == F.col("_signal"), EXACT)
        .when(F.array_contains("_words", F.col("_name")), SYNONYM)
    )
    distinct = distinct.withColumn("_known", known)
    if ratio == "edit":
        near = edit_similarity(F.col("_signal"), F.col("_name"))
    else:
        # no ratio exceeds twice the shorter length over both
        a, b = F.length("_signal"), F.length("_name")
        distinct = distinct.filter(F.col("_known").isNotNull() | (2 * F.least(a, b) >= at_least * (a + b)))
        near = matching_ratio(at_least)(F.col("_signal"), F.col("_name"))
    scored = distinct.filter(F.col("_known").isNotNull()).select(
        "_name", "signal", F.col("_known").alias("score")
    ).unionByName(
        distinct.filter(F.col("_known").isNull()).select("_name", "signal", near.alias("score"))
    )
    return plain.join(scored, "_name").select("header", "signal", "score")


def match_headers(
    catalogue: DataFrame,
    file: str,
    header: str,
    position: str,
    spec: TelemetrySpec = DEFAULT,
    *,
    cut: float = CUT,
    ratio: str = "edit",
) -> DataFrame:
    """For every file, the header proposed for each signal: best pairs first, each used once.

    Of equal scores the signal that comes first in the spec goes first, then the header that comes
    first in the file. With the ``edit`` ratio all of it stays in the JVM; ``matching`` calls Python
    once per pair of distinct names.

    A file may hold any number of headers. Whatever the other signals take, a signal ends up with
    one of its own best ``len(signals)`` headers, so only those reach the assignment.
    """
    n = len(spec.signals)
    scores = pair_scores(catalogue, header, spec, ratio=ratio, at_least=cut)
    # written first, so that its size is known and only headers that match anything are shuffled by file
    scores = stored(scores.filter(F.col("score") >= cut).withColumnRenamed("header", header), "header_scores")
    listed = catalogue.join(scores.select(header).distinct(), header, "left_semi")
    listed = listed.groupBy(file, header).agg(F.min(position).alias("_position"))
    pairs = listed.join(scores, header)
    best = Window.partitionBy(file, "signal").orderBy(F.desc("score"), "_position")
    pairs = pairs.withColumn("_at", F.row_number().over(best)).filter(F.col("_at") <= n)
    order = F.create_map(*[F.lit(x) for i, s in enumerate(spec.signals) for x in (s, i)])
    pair = F.struct(
        (-F.col("score")).alias("far"),
        order[F.col("signal")].alias("place"),
        F.col("_position").alias("position"),
        "signal",
        F.col(header).alias("header"),
    )
    # at most len(signals) ** 2 pairs per file, best first
    ranked = pairs.groupBy(file).agg(F.sort_array(F.collect_list(pair)).alias("_pairs"))
    kind = ranked.schema["_pairs"].dataType.simpleString()

    def take(taken: Column, p: Column) -> Column:
        used = F.exists(taken, lambda t: (t["signal"] == p["signal"]) | (t["header"] == p["header"]))
        return F.when(used, taken).otherwise(F.concat(taken, F.array(p)))

    chosen = F.aggregate("_pairs", F.array().cast(kind), take)
    return ranked.select(file, F.explode(chosen).alias("_p")).select(
        file, F.col("_p.signal").alias("signal"), F.col("_p.header").alias(header), (-F.col("_p.far")).alias("score")
    )


def suggest_mapping(
    spark: SparkSession, headers: Sequence[str], spec: TelemetrySpec = DEFAULT
) -> dict[str, str | None]:
    """The proposal for one file's header line."""
    rows = [(0, h, i) for i, h in enumerate(headers)]
    catalogue = spark.createDataFrame(rows, "file int, header string, position int")
    found = match_headers(catalogue, "file", "header", "position", spec).collect()
    hits = {r["signal"]: r["header"] for r in found}
    return {s: hits.get(s) for s in spec.signals}
