"""Queries on sources, sinks, projections, joins and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetwise.functions import scalars as fn
from fleetwise.operators import aggregates as agg
from fleetwise.operators import headers as hd
from fleetwise.operators import projection as pj
from fleetwise.operators import rollup as ru
from fleetwise.operators import windows as wn
from fleetwise.queries.base import (
    COLUMNS,
    each,
    on_readings,
    query,
    rd,
    rounded,
    scored,
    union,
)
from fleetwise.shared import new_path
from fleetwise.sources import readings as src
from fleetwise.sources.stand_in import readings, readings_at, table
from fleetwise.spec import DEFAULT, SIGNAL_BOUNDS, SIGNALS

LABELS = "failure_within_h, failure_mode, anomaly_type, is_outlier"


@query("load_readings", on_readings("SELECT * FROM readings"))
def load_readings(spark, sf_dir):
    path, _ = readings_at(spark, sf_dir)
    return src.load_readings(spark, path)


MESSY = {
    "engine_speed_rpm": "RPM",
    "coolant_temp_c": "Coolant Temp",
    "oil_pressure_kpa": "oil_press",
    "engine_load_pct": "Load%",
    "vibration_mms": "vibration",
}


@query(
    "read_batch",
    on_readings(
        union(
            "SELECT '$' AS signal, count($) AS n_values, min($) AS low, max($) AS high FROM readings",
            [s for s in SIGNALS if s in MESSY],
        )
    ),
)
def read_batch(spark, sf_dir):
    path = new_path(spark, "batch") + ".csv"
    df = readings(spark, sf_dir)
    df.select(*[F.col(s).alias(h) for s, h in MESSY.items()]).write.option("header", True).csv(path)
    batch = src.read_batch(spark, path)
    mapping = pj.resolve_mapping(batch.columns, MESSY)
    pj.assert_scorable(pj.coerce_numeric(batch, mapping), mapping)
    typed = pj.coerce_numeric(batch, mapping)
    sums = typed.agg(
        *[f(s).alias(f"{s}_{k}") for s in MESSY for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]
    )
    entries = [
        F.struct(
            F.lit(s).alias("signal"),
            F.col(f"{s}_n").alias("n_values"),
            F.col(f"{s}_lo").alias("low"),
            F.col(f"{s}_hi").alias("high"),
        )
        for s in MESSY
    ]
    return sums.select(F.inline(F.array(*entries)))


@query(
    "write_sample",
    on_readings(
        "SELECT unit_id, CAST(CAST(timestamp_h AS FLOAT) AS DOUBLE) AS timestamp_h,\n"
        + each("CAST(CAST($ AS FLOAT) AS DOUBLE) AS $")
        + f", {LABELS} FROM readings"
    ),
)
def write_sample(spark, sf_dir):
    path = new_path(spark, "sample")
    src.write_sample(readings(spark, sf_dir), path)
    back = spark.read.parquet(path)
    return back.withColumns({c: F.col(c).cast("double") for c in ("timestamp_h", *SIGNALS)})


@query("select_features", on_readings(f"SELECT unit_id, t_index, {COLUMNS} FROM readings"))
def select_features(spark, sf_dir):
    return pj.select_features(readings(spark, sf_dir), keep=DEFAULT.key)


def _guarded(df, guard):
    """One row per column: its values and whether the guard refuses it."""

    def refused(c):
        try:
            guard([c])
        except pj.Leakage:
            return True
        return False

    sums = df.agg(*[F.count(c).alias(c) for c in df.columns])
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(c).alias("n_values"),
            F.lit(refused(c)).alias("refused"),
        )
        for c in df.columns
    ]
    return sums.select(F.inline(F.array(*entries)))


def _guard_sql(columns, refused):
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, count({c}) AS n_values, {str(c in refused).lower()} AS refused FROM timed"
        for c in columns
    )


_ALL = ["unit_id", "t_index", "timestamp_h", *SIGNALS, *DEFAULT.label_side]
_TIMED = """timed AS (SELECT r.*, CASE WHEN failure_within_h = 1 THEN
  max(CASE WHEN failure_within_h = 1 THEN timestamp_h END) OVER (PARTITION BY unit_id) + 2e0 - timestamp_h
  END AS ttf_or_null FROM readings r)"""


@query("assert_no_leakage", on_readings(_guard_sql(_ALL, DEFAULT.label_side), _TIMED))
def assert_no_leakage(spark, sf_dir):
    return _guarded(readings(spark, sf_dir), pj.assert_no_leakage)


@query("assert_honest", on_readings(_guard_sql(_ALL, DEFAULT.label_side), _TIMED))
def assert_honest(spark, sf_dir):
    return _guarded(readings(spark, sf_dir), pj.assert_honest)


_TEXT = """texts AS (SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linenumber = 3 THEN 'n/a' ELSE CAST(l_quantity AS VARCHAR) END AS load_text,
  l_returnflag AS flag_text, CAST(l_discount AS VARCHAR) AS coolant_text FROM lineitem)"""


@query(
    "coerce_numeric",
    f"WITH {_TEXT} SELECT l_orderkey, l_linenumber, "
    + ", ".join(
        f"{ {'engine_load_pct': 'TRY_CAST(load_text AS DOUBLE)', 'oil_pressure_kpa': 'TRY_CAST(flag_text AS DOUBLE)', 'coolant_temp_c': 'TRY_CAST(coolant_text AS DOUBLE)'}.get(s, 'CAST(NULL AS DOUBLE)')} AS {s}"
        for s in SIGNALS
    )
    + " FROM texts",
)
def coerce_numeric(spark, sf_dir):
    texts = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_linenumber") == 3, "n/a")
        .otherwise(F.col("l_quantity").cast("string"))
        .alias("load_text"),
        F.col("l_returnflag").alias("flag_text"),
        F.col("l_discount").cast("string").alias("coolant_text"),
    )
    mapping = {
        "engine_load_pct": "load_text",
        "oil_pressure_kpa": "flag_text",
        "coolant_temp_c": "coolant_text",
    }
    return pj.coerce_numeric(texts, mapping, keep=["l_orderkey", "l_linenumber"])


_WANTED = {
    "engine_load_pct": "l_quantity",
    "coolant_temp_c": "l_discount",
    "oil_pressure_kpa": "no_such_header",
    "not_a_signal": "l_tax",
}


def _mapping_sql():
    rows = []
    for s in SIGNALS:
        h = _WANTED.get(s) if _WANTED.get(s) != "no_such_header" else None
        rows.append(
            f"SELECT '{s}' AS signal, CAST({repr(h) if h else 'NULL'} AS VARCHAR) AS header, "
            f"{'true' if h else 'false'} AS mapped, count(*) AS n_rows, "
            f"{f'count({h})' if h else 'CAST(0 AS BIGINT)'} AS n_values FROM lineitem"
        )
    return "\nUNION ALL\n".join(rows)


@query("resolve_mapping", _mapping_sql())
def resolve_mapping(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return pj.mapping_table(df, pj.resolve_mapping(df.columns, _WANTED))


@query("assert_scorable", _mapping_sql())
def assert_scorable(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    mapping = pj.resolve_mapping(df.columns, _WANTED)
    pj.assert_scorable(pj.coerce_numeric(df, mapping), mapping)
    return pj.mapping_table(df, mapping)


@query("downsample", on_readings(f"SELECT unit_id, t_index, {COLUMNS} FROM readings WHERE t_index % 30 = 0"))
def downsample(spark, sf_dir):
    df = readings(spark, sf_dir).select(*DEFAULT.key, *SIGNALS)
    return pj.downsample(df, 30)


@query(
    "keep_units",
    on_readings(
        f"SELECT unit_id, t_index, {COLUMNS} FROM readings WHERE unit_id IN "
        "(SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000e0)"
    ),
)
def keep_units(spark, sf_dir):
    rich = table(spark, sf_dir, "supplier").filter(F.col("s_acctbal") > 5000.0)
    units = rich.select(F.col("s_suppkey").cast("bigint").alias("unit_id"))
    return pj.keep_units(readings(spark, sf_dir).select(*DEFAULT.key, *SIGNALS), units)


SHIFTS = {
    "coolant_temp_c": 25.0,
    "egt_c": 25.0,
    "oil_pressure_kpa": 25.0,
    "boost_pressure_kpa": 25.0,
}


@query(
    "scenario_shift",
    on_readings(
        "SELECT unit_id, t_index, "
        + ", ".join(f"{s} + 25e0 AS {s}" if s in SHIFTS else s for s in SIGNALS)
        + " FROM readings"
    ),
)
def scenario_shift(spark, sf_dir):
    return pj.scenario_shift(readings(spark, sf_dir).select(*DEFAULT.key, *SIGNALS), SHIFTS)


@query(
    "range_check",
    on_readings(
        "\nUNION ALL\n".join(
            f"SELECT '{s}' AS signal, count(*) FILTER ({s} < {lo!r}e0) AS n_below, "
            f"count(*) FILTER ({s} > {hi!r}e0) AS n_above, "
            f"count(*) FILTER ({s} BETWEEN {lo!r}e0 AND {hi!r}e0) AS n_inside FROM readings"
            for s, (lo, hi) in SIGNAL_BOUNDS.items()
        )
    ),
)
def range_check(spark, sf_dir):
    return pj.range_check(readings(spark, sf_dir))


@query(
    "missing_profile",
    on_readings(
        union(
            "SELECT '$' AS signal, count(*) AS n_rows, count(*) - count($) AS n_null, count($) > 0 AS provided FROM readings"
        )
    ),
)
def missing_profile(spark, sf_dir):
    return pj.missing_profile(readings(spark, sf_dir))


# -- joins ---------------------------------------------------------------------------------------

_EVENTS = """steps AS (SELECT min(d) AS step FROM (SELECT timestamp_h - lag(timestamp_h)
  OVER (PARTITION BY unit_id ORDER BY t_index) AS d FROM readings) WHERE d > 0),
events_at AS (SELECT unit_id, max(timestamp_h) + max(step) AS event_time FROM readings, steps
  WHERE failure_within_h = 1 GROUP BY unit_id)"""


# The same beside every row, with windows: the readings are read once.
_BESIDE = """beside AS (SELECT *, max(CASE WHEN failure_within_h = 1 THEN timestamp_h END) OVER (PARTITION BY unit_id)
  + min(CASE WHEN d > 0 THEN d END) OVER () AS event_time FROM (SELECT *, timestamp_h - lag(timestamp_h)
  OVER (PARTITION BY unit_id ORDER BY t_index) AS d FROM readings))"""


@query("event_time_to_rows", on_readings("SELECT unit_id, t_index, event_time FROM beside", _BESIDE))
def event_time_to_rows(spark, sf_dir):
    return wn.time_to_failure(readings(spark, sf_dir)).select(*DEFAULT.key, "event_time")


@query(
    "unit_to_class",
    on_readings(
        "SELECT unit_id, t_index, s_nationkey AS unit_class FROM readings LEFT JOIN supplier ON s_suppkey = unit_id"
    ),
)
def unit_to_class(spark, sf_dir):
    classes = unit_classes(spark, sf_dir)
    return readings(spark, sf_dir).select(*DEFAULT.key).join(classes, "unit_id", "left")


def unit_classes(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("bigint").alias("unit_id"), F.col("s_nationkey").alias("unit_class")
    )


@query(
    "semi_join_units",
    on_readings(
        "SELECT unit_id, t_index, failure_within_h FROM (SELECT *, "
        "bool_or(failure_mode = 'bearing') OVER (PARTITION BY unit_id) AS hit FROM readings) WHERE hit"
    ),
)
def semi_join_units(spark, sf_dir):
    df = readings(spark, sf_dir)
    units = df.filter(F.col("failure_mode") == "bearing").select("unit_id").distinct()
    return pj.keep_units(df.select(*DEFAULT.key, "failure_within_h"), units)


@query(
    "readings_with_scores",
    on_readings("SELECT unit_id, t_index, coolant_temp_c, score FROM scored"),
)
def readings_with_scores(spark, sf_dir):
    scores = scored(spark, sf_dir).select(*DEFAULT.key, "score")
    return ru.join_scores(readings(spark, sf_dir).select(*DEFAULT.key, "coolant_temp_c"), scores)


@query(
    "external_column",
    on_readings(
        "SELECT unit_id, t_index, failure_within_h, score, least(1e0, engine_load_pct / 100e0) AS outside FROM scored"
    ),
)
def external_column(spark, sf_dir):
    df = scored(spark, sf_dir)
    own = df.select(*DEFAULT.key, "failure_within_h", "score")
    other = df.select(*DEFAULT.key, fn.clip(F.col("engine_load_pct") / 100.0).alias("outside"))
    return ru.join_scores(own, other)


_PLAIN = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]', '', 'g')"
_WORDS = "words AS (SELECT signal, synonym FROM (VALUES {}) AS v(signal, synonym))".format(
    ", ".join(f"('{s}', '{w}')" for s in SIGNALS for w in hd.SYNONYMS[s])
)
_NAMES = """names AS (SELECT DISTINCT header FROM (
  SELECT unnest(string_split(p_name, ' ')) AS header FROM part
  UNION ALL SELECT p_type FROM part UNION ALL SELECT p_brand FROM part))"""
_SIGNALS = "signals AS (SELECT signal FROM (VALUES {}) AS v(signal))".format(
    ", ".join(f"('{s}')" for s in SIGNALS)
)


def header_words(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    words = parts.select(F.explode(F.split("p_name", " ", -1)).alias("header"))
    return words.unionByName(parts.select(F.col("p_type").alias("header"))).unionByName(
        parts.select(F.col("p_brand").alias("header"))
    )


_PAIRS = f"""SELECT header, signal, CASE WHEN h = '' THEN 0e0 WHEN h = s THEN 1e0
  WHEN EXISTS (SELECT 1 FROM words w WHERE w.signal = p.signal AND w.synonym = p.h) THEN 0.95e0
  ELSE $near END AS score
FROM (SELECT header, signal, {_PLAIN.format('header')} AS h, {_PLAIN.format('signal')} AS s FROM names, signals) p"""
_EDIT = rd("1e0 - levenshtein(s, h) / CAST(greatest(length(s), length(h)) AS DOUBLE)", 9)


@query(
    "signal_by_header",
    f"WITH {_NAMES}, {_SIGNALS}, {_WORDS} SELECT header, signal FROM (" + _PAIRS.replace("$near", "0e0") + ")",
)
def signal_by_header(spark, sf_dir):
    return hd.pair_scores(header_words(spark, sf_dir), "header", ratio="edit").select("header", "signal")


@query("string_similarity", f"WITH {_NAMES}, {_SIGNALS}, {_WORDS} " + _PAIRS.replace("$near", _EDIT))
def string_similarity(spark, sf_dir):
    pairs = hd.pair_scores(header_words(spark, sf_dir), "header", ratio="edit")
    return pairs.withColumn("score", rounded("score", 9))


_FITTED = "fitted AS (SELECT *, " + each("avg($) OVER () AS $_m, stddev_samp($) OVER () AS $_s") + " FROM readings)"


@query(
    "parameters_to_rows",
    on_readings(
        "SELECT unit_id, t_index, "
        + each(rd("coalesce(($ - $_m) / coalesce(nullif($_s, 0), 1e0), 0e0)", 4) + " AS $")
        + " FROM fitted",
        _FITTED,
    ),
)
def parameters_to_rows(spark, sf_dir):
    df = readings(spark, sf_dir)
    fitted = agg.signal_moments(df)
    return df.select(
        *DEFAULT.key, *[rounded(agg.standardised(fitted, s), 4).alias(s) for s in SIGNALS]
    )


# -- scalar functions ----------------------------------------------------------------------------


@query(
    "clip_and_sign",
    on_readings(
        """SELECT unit_id, t_index, least(greatest((coolant_temp_c - 80e0) / 40e0, 0e0), 1e0) AS clipped,
  abs(oil_pressure_kpa - 350e0) AS distance, CAST(sign(oil_pressure_kpa - 350e0) AS DOUBLE) AS direction,
  greatest(engine_load_pct, fuel_rate_lph) AS larger FROM readings"""
    ),
)
def clip_and_sign(spark, sf_dir):
    off = F.col("oil_pressure_kpa") - 350.0
    return readings(spark, sf_dir).select(
        *DEFAULT.key,
        fn.clip((F.col("coolant_temp_c") - 80.0) / 40.0).alias("clipped"),
        F.abs(off).alias("distance"),
        F.signum(off).alias("direction"),
        fn.highest([F.col("engine_load_pct"), F.col("fuel_rate_lph")]).alias("larger"),
    )


@query(
    "finite_or_fill",
    on_readings(
        """SELECT unit_id, t_index, coalesce(egt_c, 1e9) AS egt_c,
  CASE WHEN failure_within_h = 1 THEN event_time - timestamp_h ELSE 1e9 END AS ttf
FROM beside""",
        _BESIDE,
    ),
)
def finite_or_fill(spark, sf_dir):
    return wn.time_to_failure(readings(spark, sf_dir)).select(
        *DEFAULT.key,
        fn.finite_or(F.col("egt_c"), 1e9).alias("egt_c"),
        fn.finite_or(F.col("time_to_failure_h"), 1e9).alias("ttf"),
    )


@query(
    "normalise_text",
    f"SELECT doc_id, md5(n) AS digest, CAST(length(n) AS INT) AS n_chars FROM (SELECT doc_id, {_PLAIN.format('text')} AS n FROM documents)",
)
def normalise_text(spark, sf_dir):
    plain = fn.plain_name(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(plain).alias("digest"), F.length(plain).alias("n_chars")
    )


@query(
    "one_hot",
    on_readings(
        "SELECT unit_id, t_index, "
        + ", ".join(
            f"CASE WHEN failure_mode = '{m}' THEN 1 ELSE 0 END AS failure_mode__{m}"
            for m in ("overheat", "oil_starve", "bearing")
        )
        + " FROM readings"
    ),
)
def one_hot(spark, sf_dir):
    modes = ("overheat", "oil_starve", "bearing")
    return readings(spark, sf_dir).select(*DEFAULT.key, *fn.one_hot("failure_mode", modes))


@query(
    "json_to_map_and_back",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k,
  CAST(len(json_keys(props)) AS INT) AS n_keys, true AS same FROM events""",
)
def json_to_map_and_back(spark, sf_dir):
    held = table(spark, sf_dir, "events").select("event_id", fn.json_to_map(F.col("props")).alias("m"))
    again = fn.json_to_map(fn.map_to_json(F.col("m")))
    return held.select(
        "event_id",
        F.try_element_at("m", F.lit("k")).alias("k"),
        F.size("m").alias("n_keys"),
        (F.map_entries(again) == F.map_entries("m")).alias("same"),
    )


@query(
    "utc_normalise",
    "SELECT event_id, CAST(date_diff('second', TIMESTAMP '1970-01-01', ts) - 7200 AS BIGINT) AS utc_seconds FROM events",
)
def utc_normalise(spark, sf_dir):
    at = fn.utc(F.col("ts").cast("timestamp"), "+02:00")
    zero = F.lit("1970-01-01").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        "event_id", (F.unix_seconds(at) - F.unix_seconds(zero)).alias("utc_seconds")
    )


@query(
    "truncate_text",
    "SELECT doc_id, md5(left(text, 500)) AS digest, CAST(length(left(text, 500)) AS INT) AS n_chars FROM documents",
)
def truncate_text(spark, sf_dir):
    cut = fn.short_error(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(cut).alias("digest"), F.length(cut).alias("n_chars")
    )


@query(
    "known_signals",
    on_readings(
        f"SELECT unit_id, t_index, 9 AS n_keys, {COLUMNS}, CAST(NULL AS DOUBLE) AS stranger FROM readings"
    ),
)
def known_signals(spark, sf_dir):
    wide = F.map_concat(
        fn.signal_map(SIGNALS), F.create_map(F.lit("stranger"), F.col("timestamp_h"))
    )
    kept = readings(spark, sf_dir).select(*DEFAULT.key, fn.known_signals(wide, SIGNALS).alias("m"))
    return kept.select(
        *DEFAULT.key,
        F.size("m").alias("n_keys"),
        *fn.signals_from_map(F.col("m"), [*SIGNALS, "stranger"]),
    )
