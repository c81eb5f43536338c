"""Set-wise as-of lookup of lagged readings.

For each request and each lag slot of its city the reference asks the
document store for the oldest reading newer than ``now - k`` (J1) or the
newest reading newer than ``now - k`` (J2), one request at a time.  Here all
requests of a batch are answered in one sort-based pass, with no range join
and no request x reading pairs:

1. every request becomes one *probe row* per slot, placed in the time order
   at ``now - k`` (earliest) or at ``now`` (latest);
2. probes and readings are shuffled together on ``(city, station, bucket)``,
   where ``bucket`` is a time bucket of width ``B``.  A reading is also
   copied into the previous bucket when it lies within the city's largest
   lookback ``D`` of the bucket start, and all probes of a request go to the
   bucket of ``now - D``; so each partition holds every reading any of its
   probes can need.  Buckets split a hot station over many tasks;
3. one sort per partition and ``lead``/``lag`` ``IGNORE NULLS`` give the
   first reading after and the last reading before each probe (O(n));
4. probes are regrouped per request on keys that contain the shuffle keys,
   so the regroup needs no second exchange (and, with the request columns as
   keys, only fixed-width buffers: a hash aggregate, no extra sort).

Ordering is ``(ts, probe after reading, reading_id)``: a reading exactly at
``now - k`` is not "newer than" the cutoff (strict ``>``, P11), a reading
exactly at ``now`` is in the window, and equal timestamps are broken by
``reading_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockcast.config import CITY_RULES, NO_HISTORY, OK, CityRule, RunParams

SLOTS = (1, 2, 3, 4)
SLOT_COLS = tuple(f"slot{i}" for i in SLOTS)


def _lookup_rules(rules: dict[str, CityRule]) -> dict[str, CityRule]:
    return {c: r for c, r in rules.items() if r.lookups}


def lag_lookup(
    requests: DataFrame,
    history: DataFrame,
    params: RunParams = RunParams(),
    rules: dict[str, CityRule] = CITY_RULES,
) -> DataFrame:
    """Add ``slot1..slot4`` (int) to every request and mark ``no_history``.

    ``requests`` needs ``request_id, city, station_id, requested_at, status``;
    ``history`` needs ``city, station_id, ts, available, reading_id``.
    Only rows with status ok of a city with lookups are probed; cities
    without lookups get zero lags (as the reference feeds its model), and
    rows that are not ok get null lags.  ``params.lookup_plan`` picks the
    one-shuffle window plan or the two-level slot-summary plan (same answers);
    ``params.bound_history`` first restricts the history to the requests'
    time range.
    """
    probed = _probed(rules)
    answers = _answers(requests.where(probed), requests, history, params, rules)
    rest = requests.where(~probed | F.col("status").isNull() | F.col("city").isNull())
    return _with_rest(answers, rest, rules, requests.columns)


def _probed(rules: dict[str, CityRule]) -> Column:
    return F.col("city").isin(list(_lookup_rules(rules))) & (F.col("status") == OK)


def shared_lag_lookup(
    requests: DataFrame,
    history: DataFrame,
    params: RunParams = RunParams(),
    rules: dict[str, CityRule] = CITY_RULES,
) -> DataFrame:
    """As ``lag_lookup``, with each distinct (city, station, now) looked up once.

    The requests are written first (``settled``), so their validation runs once and
    only typed columns are read again.  The distinct keys are pre-aggregated before
    their shuffle, so a station asked for by half of a batch is one key there; the
    answers are joined back by a plain join, which AQE broadcasts once measured
    small or splits where a key is hot.
    """
    requests = settled(requests)
    keys = ["city", "station_id", "requested_at"]
    probed = _probed(rules)
    asked = requests.where(probed).select(*keys).distinct().withColumn("status", F.lit(OK))
    answers = _answers(asked, requests, history, params, rules)
    answers = answers.select(*keys, *[F.col(c).alias(f"_{c}") for c in SLOT_COLS], F.col("status").alias("_status"))
    no_lookup = F.col("city").isin([c for c, r in rules.items() if not r.lookups]) & (F.col("status") == OK)
    slots = [F.when(probed, F.col(f"_{c}")).when(no_lookup, 0).cast("int").alias(c) for c in SLOT_COLS]
    status = F.when(probed, F.col("_status")).otherwise(F.col("status")).alias("status")
    others = [F.col(c) for c in requests.columns if c != "status"]
    return requests.join(answers, keys, "left").select(*others, *slots, status)


def settled(requests: DataFrame) -> DataFrame:
    """``requests`` written to the shared folder and read back: what made them runs
    once, however many branches of a plan read them, and filters on their columns
    are filters of a Parquet scan."""
    import uuid

    from dockcast.session import checkpoint_dir

    spark = requests.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/requests-{uuid.uuid4().hex}"
    requests.write.parquet(path)
    return spark.read.schema(requests.schema).parquet(path)


def _answers(
    needs: DataFrame, requests: DataFrame, history: DataFrame, params: RunParams, rules: dict[str, CityRule]
) -> DataFrame:
    """The probed rows ``needs`` with their slots and status; ``requests`` (a superset
    of them) bounds the history."""
    lrules = _lookup_rules(rules)
    unit = params.lag_unit
    bucket_us = bucket_micros(params, rules)
    if params.bound_history:
        # bounds over all requests (a superset of the probed ones): only
        # requested_at is read, so validation work is pruned from this pass
        history = bound_history(history, requests, max(r.lookback for r in lrules.values()) * unit)

    # --- probe rows: one per (request, slot) --------------------------------
    def ts_minus(seconds: int) -> str:
        return f"timestampadd(SECOND, {-int(seconds)}, requested_at)"

    def probes_of(rule: CityRule) -> str:
        # all probes of a request share the bucket of now - D (the anchor)
        anchor = ts_minus(rule.lookback * unit)
        return "array(" + ", ".join(
            f"named_struct('slot', {lk.slot}, 'forward', {str(lk.kind == 'earliest').lower()}, "
            f"'start', {ts_minus(lk.k * unit)}, 'anchor', {anchor})"
            for lk in rule.lookups
        ) + ")"

    probe_case = "CASE city " + " ".join(f"WHEN '{c}' THEN {probes_of(r)}" for c, r in lrules.items()) + " END"
    payload_cols = [c for c in needs.columns if c not in ("city", "station_id", "status")]
    payload = [f"`{c}`" for c in payload_cols]
    if params.lookup_plan in ("auto", "two_level"):
        return _two_level(needs, history, params, rules, payload_cols, probe_case, needs.columns)
    if params.lookup_plan != "window":
        raise ValueError(f"unknown lookup plan {params.lookup_plan!r}")

    probes = needs.selectExpr("city", "station_id", *payload, f"explode({probe_case}) AS p").selectExpr(
        "city",
        "station_id",
        f"CAST(floor({_epoch('p.anchor')} / {bucket_us}) AS BIGINT) AS bucket",
        "CASE WHEN p.forward THEN p.start ELSE requested_at END AS sort_ts",
        "1 AS tie",
        "CAST(NULL AS BIGINT) AS reading_id",
        "CAST(NULL AS STRUCT<ts: TIMESTAMP_NTZ, available: INT>) AS r",
        "p.slot AS slot",
        "p.forward AS forward",
        "p.start AS start",
        "requested_at AS end",
        *payload,
    )

    readings = reading_rows(history, params, rules)

    both = probes.unionByName(readings, allowMissingColumns=True)
    window = "(PARTITION BY city, station_id, bucket ORDER BY sort_ts, tie, reading_id)"
    scanned = both.selectExpr(
        "*", f"lead(r, 1) IGNORE NULLS OVER {window} AS nxt", f"lag(r, 1) IGNORE NULLS OVER {window} AS prv"
    ).where("tie = 1")

    # J1 (O2/A1 min-by-time) and J2 (O1/A1 max-by-time) in one expression
    value = (
        "CASE WHEN forward THEN (CASE WHEN nxt.ts <= end THEN nxt.available END) "
        "ELSE (CASE WHEN prv.ts > start THEN prv.available END) END"
    )

    # Request columns are grouping keys (functionally dependent on request_id):
    # the buffers stay fixed-width, so this is a hash aggregate, and as the keys
    # contain the shuffle keys it needs no exchange.
    per_request = scanned.groupBy("city", "station_id", "bucket", *payload_cols).agg(
        *[F.expr(f"max(CASE WHEN slot = {i} THEN {value} END)").alias(f"slot{i}") for i in SLOTS],
        F.expr(f"count({value}) = count(1)").alias("complete"),
    )
    return per_request.selectExpr(
        *[f"`{c}`" for c in needs.columns if c != "status"],
        *SLOT_COLS,
        f"CASE WHEN complete THEN '{OK}' ELSE '{NO_HISTORY}' END AS status",
    )


def _with_rest(looked_up: DataFrame, rest: DataFrame, rules: dict[str, CityRule], columns: list[str]) -> DataFrame:
    """Union back the rows that were not probed: zero lags for cities without
    lookups (as the reference feeds its model), null lags for rows not ok."""
    no_lookup = ", ".join(f"'{c}'" for c, r in rules.items() if not r.lookups) or "''"
    zero_or_null = f"CAST(CASE WHEN city IN ({no_lookup}) AND status = '{OK}' THEN 0 END AS INT)"
    rest = rest.selectExpr(*[f"`{c}`" for c in columns], *[f"{zero_or_null} AS {c}" for c in SLOT_COLS])
    return looked_up.unionByName(rest.select(*looked_up.columns))


def _two_level(
    needs: DataFrame,
    history: DataFrame,
    params: RunParams,
    rules: dict[str, CityRule],
    payload_cols: list[str],
    probe_case: str,
    columns: list[str],
) -> DataFrame:
    """Lookup over slot summaries: exact, and per-task work bounded by slots.

    Level A shuffles raw readings and probes on ``(city, station, slot)`` (a
    slot is ``slot_seconds`` wide): within its slot each probe finds its
    neighbour reading, and each slot is reduced to its first and last reading.
    Level B shuffles those summaries (copied into the previous bucket near a
    bucket start, as the window plan does with readings) and the probes on
    ``(city, station, bucket)``: a probe with no neighbour inside its own slot
    takes the first reading of the next non-empty slot (earliest) or the last
    reading of the previous one (latest).  The regroup again needs no exchange.
    """
    lrules = _lookup_rules(rules)
    g_us = params.slot_seconds * 1_000_000
    # context needed past a bucket's end is D + one slot: the bucket must be at
    # least that wide (so one copy suffices) and a whole number of slots
    d_max_us = max(r.lookback for r in lrules.values()) * params.lag_unit * 1_000_000
    bucket_us = -(-max(bucket_micros(params, rules), d_max_us + g_us) // g_us) * g_us
    payload = [f"`{c}`" for c in payload_cols]
    reading = "STRUCT<ts: TIMESTAMP_NTZ, id: BIGINT, available: INT>"

    probes = needs.selectExpr("city", "station_id", *payload, f"explode({probe_case}) AS p").selectExpr(
        "city",
        "station_id",
        f"CAST(floor({_epoch('CASE WHEN p.forward THEN p.start ELSE requested_at END')} / {g_us}) AS BIGINT) AS fine",
        "CASE WHEN p.forward THEN p.start ELSE requested_at END AS sort_ts",
        "1 AS tie",
        "CAST(NULL AS BIGINT) AS reading_id",
        f"CAST(NULL AS {reading}) AS r",
        "p.slot AS slot",
        "p.forward AS forward",
        "p.start AS start",
        "requested_at AS end",
        # probes of a request share the bucket of (now - D - one slot)
        f"CAST(floor(({_epoch('p.anchor')} - {g_us}) / {bucket_us}) AS BIGINT) AS bucket",
        *payload,
    )
    cities = ", ".join(f"'{c}'" for c in lrules)
    raw = history.where(f"city IN ({cities})").selectExpr(
        "city",
        "station_id",
        f"CAST(floor({_epoch('ts')} / {g_us}) AS BIGINT) AS fine",
        "ts AS sort_ts",
        "0 AS tie",
        "reading_id",
        "named_struct('ts', ts, 'id', reading_id, 'available', available) AS r",
    )
    wa = "PARTITION BY city, station_id, fine ORDER BY sort_ts, tie, reading_id"
    whole = f"({wa} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    level_a = probes.unionByName(raw, allowMissingColumns=True).selectExpr(
        "*",
        f"lead(r, 1) IGNORE NULLS OVER ({wa}) AS nxt_in",
        f"lag(r, 1) IGNORE NULLS OVER ({wa}) AS prv_in",
        f"first(r, true) OVER {whole} AS s_first",
        f"last(r, true) OVER {whole} AS s_last",
    )

    # One pass over level A feeds level B (two branches would recompute it):
    # a probe keeps its in-slot neighbour ("latest" probes sort before their own
    # slot); the row of each slot's first reading becomes the slot summary.
    d_city = "CASE city " + " ".join(
        f"WHEN '{c}' THEN {r.lookback * params.lag_unit * 1_000_000 + g_us}" for c, r in lrules.items()
    ) + " END"
    start_us = f"(fine * {g_us})"
    home = f"CAST(floor({start_us} / {bucket_us}) AS BIGINT)"
    buckets = (
        f"CASE WHEN tie = 1 THEN array(bucket) "
        f"WHEN {start_us} - {home} * {bucket_us} < {d_city} THEN array({home}, {home} - 1) ELSE array({home}) END"
    )
    level_b_rows = level_a.where("tie = 1 OR reading_id = s_first.id").selectExpr(
        "city",
        "station_id",
        f"explode({buckets}) AS bucket",
        "fine",
        "CASE WHEN tie = 0 THEN 0 WHEN forward THEN 1 ELSE -1 END AS tie",
        "CASE WHEN tie = 0 THEN named_struct('first', s_first, 'last', s_last) END AS s",
        "slot",
        "forward",
        "start",
        "end",
        "CASE WHEN tie = 1 THEN (CASE WHEN forward THEN nxt_in ELSE prv_in END) END AS near",
        *payload,
    )
    wb = "(PARTITION BY city, station_id, bucket ORDER BY fine, tie)"
    level_b = level_b_rows.selectExpr(
        "*", f"lead(s, 1) IGNORE NULLS OVER {wb} AS nxt_s", f"lag(s, 1) IGNORE NULLS OVER {wb} AS prv_s"
    ).where("tie <> 0")
    value = (
        "CASE WHEN forward THEN (CASE WHEN coalesce(near, nxt_s.first).ts <= end THEN coalesce(near, nxt_s.first).available END) "
        "ELSE (CASE WHEN coalesce(near, prv_s.last).ts > start THEN coalesce(near, prv_s.last).available END) END"
    )
    per_request = level_b.groupBy("city", "station_id", "bucket", *payload_cols).agg(
        *[F.expr(f"max(CASE WHEN slot = {i} THEN {value} END)").alias(f"slot{i}") for i in SLOTS],
        F.expr(f"count({value}) = count(1)").alias("complete"),
    )
    return per_request.selectExpr(
        *[f"`{c}`" for c in columns if c != "status"],
        *SLOT_COLS,
        f"CASE WHEN complete THEN '{OK}' ELSE '{NO_HISTORY}' END AS status",
    )


def bound_history(history: DataFrame, requests: DataFrame, lookback_seconds: int) -> DataFrame:
    """Keep only readings some probe can reach: ``(min(now) - D, max(now)]``.

    The bounds come from one aggregate over the probed requests and are
    applied as literals, so they become pushed filters on the history scan
    (and prune day folders of the partitioned store).  A batch of recent
    requests then reads hours of history, not all of it.
    """
    import datetime as dt

    from dockcast.functions import ntz_literal

    lo, hi = requests.agg(F.min("requested_at"), F.max("requested_at")).first()
    if lo is None:
        return history.where(F.lit(False))
    start = lo - dt.timedelta(seconds=lookback_seconds)
    return history.where((F.col("ts") > ntz_literal(start)) & (F.col("ts") <= ntz_literal(hi)))


def _epoch(col: str) -> str:
    return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {col})"


def bucket_micros(params: RunParams, rules: dict[str, CityRule] = CITY_RULES) -> int:
    lrules = _lookup_rules(rules)
    d_max = max(r.lookback for r in lrules.values()) * params.lag_unit
    return max(params.bucket_units * params.lag_unit, d_max) * 1_000_000


def reading_rows(history: DataFrame, params: RunParams = RunParams(), rules: dict[str, CityRule] = CITY_RULES) -> DataFrame:
    """Reading side of the lookup shuffle: home bucket, plus the previous
    bucket when the reading lies within the city's lookback of its bucket start."""
    lrules = _lookup_rules(rules)
    unit, bucket_us = params.lag_unit, bucket_micros(params, rules)
    home = f"CAST(floor({_epoch('ts')} / {bucket_us}) AS BIGINT)"
    d_city = "CASE city " + " ".join(f"WHEN '{c}' THEN {r.lookback * unit * 1_000_000}" for c, r in lrules.items()) + " END"
    near_start = f"({_epoch('ts')} - {home} * {bucket_us}) < {d_city}"
    cities = ", ".join(f"'{c}'" for c in lrules)
    return history.where(f"city IN ({cities})").selectExpr(
        "city",
        "station_id",
        f"explode(CASE WHEN {near_start} THEN array({home}, {home} - 1) ELSE array({home}) END) AS bucket",
        "ts AS sort_ts",
        "0 AS tie",
        "reading_id",
        "named_struct('ts', ts, 'available', available) AS r",
    )


def station_names(requests: DataFrame, stations: DataFrame) -> DataFrame:
    """Attach the station name by ``(city, station_id)``; unknown ids keep a null name."""
    dim = stations.select(F.col("city"), F.col("station_id"), F.col("name").alias("station_name"))
    return requests.join(dim, ["city", "station_id"], "left")


def unknown_stations(requests: DataFrame, stations: DataFrame) -> DataFrame:
    """Requests whose ``(city, station_id)`` is not in the station dimension."""
    dim = stations.select("city", "station_id")
    return requests.join(dim, ["city", "station_id"], "left_anti")
