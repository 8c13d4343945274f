"""Queries over scalar functions, scoring expressions and fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.catalog.base import query, r9, rounded
from tidegate.catalog.pit import events, feature_sql
from tidegate.fixtures import load, source
from tidegate.functions import scalars as fn
from tidegate.functions.times import US, bucket, day_of_week, format_utc, hour_of_day, instant, micros, millis_between
from tidegate.operators import evaluate as ev
from tidegate.operators import boosting, fitting, scoring
from tidegate.operators.features import FEATURES, point_in_time
from tidegate.session import scratch
from tidegate.sources.buckets import write_bucketed


@query(
    "fn_canonical_json",
    """SELECT seq, payload_hash, length(payload_hash) AS digits FROM history""",
    ("history",),
)
def fn_canonical(spark, folder):
    """Canonical JSON and its hash."""
    h = load(spark, folder, "history")
    digest = fn.payload_hash(F.col("event_id"), F.col("customer_id"), F.col("terminal_id"), F.col("amount_minor"), F.lit("usd"), F.col("event_us"))
    return h.select("seq", digest.alias("payload_hash"), F.length(digest).cast("bigint").alias("digits"))


@query(
    "fn_strings",
    r"""SELECT c_custkey AS k, upper(c_mktsegment) AS up, regexp_matches(c_name, '^Customer#[0-9]{9}$') AS well_formed, starts_with(c_mktsegment, 'B') AS b,
               printf('C%06d', c_custkey) AS padded, trim(regexp_replace(regexp_replace(concat('** ', c_name, '   ', c_mktsegment, ' *'), '\*', '', 'g'), '\s+', ' ', 'g')) AS plain,
               sha256(c_name) AS digest FROM customer""",
)
def fn_strings(spark, folder):
    """Case, patterns, prefixes, padded ids, normalised text, digests."""
    c = source(spark, folder, "customer")
    wild = F.concat(F.lit("** "), "c_name", F.lit("   "), "c_mktsegment", F.lit(" *"))
    return c.select(
        F.col("c_custkey").alias("k"),
        F.upper("c_mktsegment").alias("up"),
        F.col("c_name").rlike("^Customer#[0-9]{9}$").alias("well_formed"),
        F.col("c_mktsegment").startswith("B").alias("b"),
        fn.padded_id("C", 6, F.col("c_custkey")).alias("padded"),
        fn.normalise_text(wild).alias("plain"),
        F.sha2("c_name", 256).alias("digest"),
    )


@query(
    "fn_times",
    """SELECT event_id AS k, epoch_us(ts) AS us, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS utc, CAST(date_part('hour', ts) AS BIGINT) AS hour,
              CAST(date_part('isodow', ts) - 1 AS BIGINT) AS weekday, epoch_us(time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '2000-01-01')) AS quarter_us,
              CAST(epoch_us(ts) % 1000000 AS DOUBLE) / 1000 AS ms FROM events""",
)
def fn_times(spark, folder):
    """Microseconds both ways, fixed-width text, hour, weekday, buckets, milliseconds. FEAT-2, FEAT-3."""
    us = micros("ts")
    return source(spark, folder, "events").select(
        F.col("event_id").alias("k"),
        micros(instant(us)).alias("us"),
        format_utc(us).alias("utc"),
        hour_of_day(us).alias("hour"),
        day_of_week(us).alias("weekday"),
        bucket(us, 900 * US).alias("quarter_us"),
        millis_between(us - F.pmod(us, F.lit(US)), us).alias("ms"),
    )


@query(
    "fn_numbers",
    """SELECT l_orderkey AS o, l_linenumber AS l, l_partkey AS p, l_suppkey AS s, round(1 / (1 + exp(-l_discount)), 9) AS sigmoid, round(ln(q / (1 - q)), 9) AS logit,
              round(ln(1 + l_quantity), 9) AS log1p, CAST(ceil(l_extendedprice) AS BIGINT) AS up, CAST(floor(l_extendedprice) AS BIGINT) AS down,
              round(sqrt((l_tax - l_discount) * (l_tax - l_discount) + (l_quantity - 1) * (l_quantity - 1)), 9) AS distance, round((l_quantity - 25) / 2, 9) AS z
       FROM (SELECT *, least(greatest(l_discount, 1e-12), 1 - 1e-12) AS q FROM lineitem) t""",
)
def fn_numbers(spark, folder):
    """Sigmoid, clipped logit, log1p, rounding, distance, standardising."""
    li = source(spark, folder, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("o"),
        F.col("l_linenumber").alias("l"),
        F.col("l_partkey").alias("p"),
        F.col("l_suppkey").alias("s"),
        r9(fn.sigmoid(F.col("l_discount")), "sigmoid"),
        r9(fn.logit(F.col("l_discount")), "logit"),
        r9(F.log1p("l_quantity"), "log1p"),
        F.ceil("l_extendedprice").alias("up"),
        F.floor("l_extendedprice").alias("down"),
        r9(fn.distance(F.col("l_tax"), F.col("l_quantity"), F.col("l_discount"), F.lit(1.0)), "distance"),
        r9(fn.standardise(F.col("l_quantity"), 25.0, 2.0), "z"),
    )


@query(
    "fn_arrays_and_nulls",
    """SELECT txn_id, coalesce(score, 0) AS score, list_has_any(reason_codes, ['NO_SCORE', 'PIPELINE_DEGRADED']) AS flagged, CAST(len(reason_codes) AS INTEGER) AS n,
              reason_codes[-1] AS last_reason, CAST(list_sum(list_transform(reason_codes, lambda x: length(x))) AS BIGINT) AS letters,
              array_to_string(list_concat(['A'], reason_codes), '+') AS joined FROM decisions""",
    ("decisions",),
)
def fn_arrays(spark, folder):
    """Missing values, overlap, size, last, sum and concatenation of arrays."""
    codes = F.col("reason_codes")
    return load(spark, folder, "decisions").select(
        "txn_id",
        fn.or_zero(F.col("score")).alias("score"),
        F.arrays_overlap(codes, F.array(F.lit("NO_SCORE"), F.lit("PIPELINE_DEGRADED"))).alias("flagged"),
        F.size(codes).alias("n"),
        F.element_at(codes, -1).alias("last_reason"),
        F.aggregate(codes, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("letters"),
        F.array_join(fn.join_reasons(F.array(F.lit("A")), codes), "+").alias("joined"),
    )


@query(
    "fn_maps",
    """SELECT scrape_us, sample, regexp_extract(sample, '^([^{]+)', 1) AS name, nullif(regexp_extract(sample, 'le="([^"]*)"', 1), '') AS le,
              nullif(regexp_extract(sample, 'status="([^"]*)"', 1), '') AS status FROM scrapes""",
    ("scrapes",),
)
def fn_maps(spark, folder):
    """Metric name and labels from the name of a sample."""
    rows = load(spark, folder, "scrapes")
    labels = fn.label_map(F.col("sample"))
    return rows.select(
        "scrape_us", "sample", fn.metric_name(F.col("sample")).alias("name"), F.element_at(labels, "le").alias("le"), F.element_at(labels, "status").alias("status")
    )


@query(
    "fn_json",
    """SELECT txn_id, CASE WHEN json_valid(value_text) THEN value_text->>'$.event_id' END AS claimed, json_valid(value_text) AS valid FROM messages""",
    ("messages",),
)
def fn_json(spark, folder):
    """Parsing a document that may be damaged, and the id that it claims."""
    rows, text = load(spark, folder, "messages"), F.col("value_text")
    valid = F.try_parse_json(text).isNotNull()
    return rows.select("txn_id", F.when(valid, F.get_json_object(text, "$.event_id")).alias("claimed"), valid.alias("valid"))


_FEATURES = {"f": feature_sql()}


def _features(spark, folder):
    return point_in_time(events(spark, folder))


# A model of the committed kind, written down as numbers; fits produce the same structure.
_MEDIANS = {"cust_amount_mean_7d": 5000.0, "cust_amount_mean_30d": 5000.0, "amount_to_cust_mean_30d": 0.75, "secs_since_prev_cust_txn": 40000.0}
_OUTPUTS = [*FEATURES, *[f"{n}__missing" for n in scoring.NULLABLE]]
_MEANS = {n: (i + 1) / 4 for i, n in enumerate(_OUTPUTS)}
_SCALES = {n: 1 + i / 2 for i, n in enumerate(_OUTPUTS)}
_COEFFICIENTS = {n: ((i * 7) % 11 - 5) / 20 for i, n in enumerate(_OUTPUTS)}
_MODEL = scoring.LinearModel(scoring.Preprocessing(medians=_MEDIANS, means=_MEANS, scales=_SCALES), _COEFFICIENTS, -1.5)


def _score_sql() -> str:
    terms = []
    for name in FEATURES:
        x = f"coalesce(CAST({name} AS DOUBLE), {_MEDIANS.get(name, 0.0)}::DOUBLE)"
        x = f"ln(1 + {x})" if name in scoring.LOG1P else x
        terms.append(f"({x} - {_MEANS[name]}::DOUBLE) / {_SCALES[name]}::DOUBLE * {_COEFFICIENTS[name]}::DOUBLE")
    for name in scoring.NULLABLE:
        out = f"{name}__missing"
        x = f"CASE WHEN {name} IS NULL THEN 1::DOUBLE ELSE 0::DOUBLE END"
        terms.append(f"({x} - {_MEANS[out]}::DOUBLE) / {_SCALES[out]}::DOUBLE * {_COEFFICIENTS[out]}::DOUBLE")
    return f"1 / (1 + exp(-(-1.5::DOUBLE + {' + '.join(terms)})))"


@query("dec2_linear_score", f"SELECT seq, round({_score_sql()}, 9) AS score FROM f", ("history",), _FEATURES)
def dec2(spark, folder):
    """DEC-2, FIT-5: an existing linear model as one column expression."""
    return _features(spark, folder).select("seq", r9(_MODEL.score(), "score"))


@query(
    "dec3_score_reasons",
    "SELECT seq, CASE WHEN cust_has_history_30d = 0 THEN 'COLD_START_CUSTOMER' ELSE '' END AS reasons FROM f",
    ("history",),
    _FEATURES,
)
def dec3(spark, folder):
    """DEC-3: reasons that come with a score."""
    reasons = scoring.indicator_reasons(F.col("cust_has_history_30d"), F.col("history_complete"))
    return _features(spark, folder).select("seq", F.array_join(reasons, ",").alias("reasons"))


@query("pred9_input_guards", "SELECT CAST(0 AS BIGINT) AS missing_required, CAST(0 AS BIGINT) AS negative_log1p FROM (SELECT count(*) FROM f) t", ("history",), _FEATURES)
def pred9(spark, folder):
    """PRED-9: rows a model must refuse."""
    return scoring.violations(scoring.checked(_features(spark, folder)))


@query(
    "fit1_medians",
    " UNION ALL ".join(f"SELECT '{f}' AS feature, round(coalesce(quantile_cont(CAST({f} AS DOUBLE), 0.5), 0), 9) AS median FROM f" for f in FEATURES),
    ("history",),
    _FEATURES,
)
def fit1(spark, folder):
    """FIT-1: the median of each feature."""
    return rounded(scoring.fit_medians(_features(spark, folder)), "median")


_RAW = {n: (f"ln(1 + coalesce(CAST({n} AS DOUBLE), (SELECT coalesce(median(CAST({n} AS DOUBLE)), 0) FROM f)))" if n in scoring.LOG1P else f"coalesce(CAST({n} AS DOUBLE), (SELECT coalesce(median(CAST({n} AS DOUBLE)), 0) FROM f))") for n in FEATURES}
_RAW |= {f"{n}__missing": f"CASE WHEN {n} IS NULL THEN 1::DOUBLE ELSE 0::DOUBLE END" for n in scoring.NULLABLE}


@query(
    "fit1_scaling",
    " UNION ALL ".join(
        f"SELECT '{n}' AS output, round(avg({x}), 6) AS mean, round(CASE WHEN stddev_pop({x}) > 0 THEN stddev_pop({x}) ELSE 1 END, 6) AS scale FROM f" for n, x in _RAW.items()
    ),
    ("history",),
    _FEATURES,
)
def fit1_scaling(spark, folder):
    """FIT-1: mean and scale of every model input."""
    prep = scoring.fit_preprocessing(_features(spark, folder).checkpoint())
    rows = [(n, round(prep.means[n], 6), round(prep.scales[n], 6)) for n in prep.outputs()]
    return spark.createDataFrame(rows, "output string, mean double, scale double")


def _labelled(spark, folder):
    """Features and labels, 1:1, split by time into a fit part and a later part."""
    labels = load(spark, folder, "scored").select(F.col("position").alias("seq"), "is_fraud")
    rows = _features(spark, folder).join(labels, "seq").checkpoint()
    return rows.filter(F.col("decision_us") < _LATER_US), rows.filter(F.col("decision_us") >= _LATER_US)


_LATER_US = 1705881600000000  # 2024-01-22 00:00 UTC
_LATER = f"""SELECT count(*) AS rows, count(*) FILTER (WHERE s.is_fraud) AS positives, round(avg(CAST(s.is_fraud AS INT)), 9) AS prevalence
             FROM history h JOIN scored s ON s.position = h.seq WHERE h.received_us >= {_LATER_US}"""


@query(
    "join1_features_with_labels",
    "SELECT f.seq, f.cust_txn_count_7d, t.is_fraud, t.label_us FROM f JOIN txn t ON t.txn_id = f.seq",
    ("history", "txn"),
    _FEATURES,
)
def join1(spark, folder):
    """JOIN-1: features joined 1:1 with labels."""
    features = _features(spark, folder).select("seq", "cust_txn_count_7d")
    labels = load(spark, folder, "txn").select(F.col("txn_id").alias("seq"), "is_fraud", "label_us")
    return features.join(labels, "seq")


@query(
    "join1_features_with_labels_bucketed",
    "SELECT f.seq, f.cust_txn_count_7d, t.is_fraud, t.label_us FROM f JOIN txn t ON t.txn_id = f.seq",
    ("history", "txn"),
    _FEATURES,
)
def join1_bucketed(spark, folder):
    """JOIN-1 over stored tables that share their buckets: the join moves no rows."""
    features = write_bucketed(_features(spark, folder).select("seq", "cust_txn_count_7d"), scratch(spark, "features"), "seq", 8)
    labels = load(spark, folder, "txn").select(F.col("txn_id").alias("seq"), "is_fraud", "label_us")
    return features.hint("merge").join(write_bucketed(labels, scratch(spark, "labels"), "seq", 8), "seq")


@query(
    "join1_uniqueness",
    """SELECT (SELECT count(*) FROM history) AS left_rows, (SELECT count(DISTINCT seq) FROM history) AS left_keys, (SELECT count(*) FROM txn) AS right_rows,
              (SELECT count(DISTINCT txn_id) FROM txn) AS right_keys, (SELECT count(*) FROM history h JOIN txn t ON t.txn_id = h.seq) AS joined_rows""",
    ("history", "txn"),
)
def join1_unique(spark, folder):
    """JOIN-1: the counts that prove a 1:1 join."""
    a, b = load(spark, folder, "history").select("seq"), load(spark, folder, "txn").select(F.col("txn_id").alias("seq"))
    count = F.count(F.lit(1))
    return (
        a.agg(count.alias("left_rows"), F.count_distinct("seq").alias("left_keys"))
        .withColumn("right_rows", b.agg(count).scalar())
        .withColumn("right_keys", b.agg(F.count_distinct("seq")).scalar())
        .withColumn("joined_rows", a.join(b, "seq").agg(count).scalar())
    )


def _well(ranked, *keys):
    """What is known of a fitted ranking: its rows, and that it is far better than chance."""
    well = (F.col("roc_auc") > 0.7) & (F.col("average_precision") > 3 * F.col("prevalence"))
    return rounded(ranked, "prevalence").select(*keys, "rows", "positives", "prevalence", well.alias("ranks_well"))


@query(
    "fit2_logistic_regression",
    """SELECT family, config, l.*, TRUE AS ranks_well FROM later l, (VALUES ('linear', 'linear:balanced=False,c=0.1'), ('linear', 'linear:balanced=False,c=1.0'),
         ('linear', 'linear:balanced=True,c=0.1'), ('linear', 'linear:balanced=True,c=1.0'), ('rules', 'rules:amount')) v(family, config)""",
    ("history", "scored"),
    {"later": _LATER},
)
def fit2(spark, folder):
    """FIT-2: linear models with and without class weights, against a rule on later rows."""
    train, later = _labelled(spark, folder)
    grid = fitting.linear_grid([0.1, 1.0], [False, True])
    scored = fitting.score_grid(train, later, grid, ["seq", "is_fraud"])
    rule = later.select("seq", "is_fraud", scoring.rule_score("amount_minor").alias("score"), F.lit("rules").alias("family"), F.lit("rules:amount").alias("config"))
    keys = ["family", "config"]
    return _well(ev.average_precision(scored.unionByName(rule), keys), *keys)


@query("fit3_boosted_trees", "SELECT *, TRUE AS ranks_well FROM later", ("history", "scored"), {"later": _LATER})
def fit3(spark, folder):
    """FIT-3: boosted trees on imputed inputs, measured on later rows."""
    train, later = _labelled(spark, folder)
    scored = fitting.fit_trees(train, depth=3, trees=5).apply(later).select("is_fraud", "score")
    return _well(ev.average_precision(scored))


@query("fit3_routed_trees", "SELECT *, TRUE AS ranks_well FROM later", ("history", "scored"), {"later": _LATER})
def fit3_routed(spark, folder):
    """FIT-3: boosted trees on raw inputs that send missing values to the better side, measured on later rows."""
    train, later = _labelled(spark, folder)
    (model,) = boosting.fit_boosted(train, [boosting.Setting(3, 6, 10.0)])
    return _well(ev.average_precision(later.select("is_fraud", model.score().alias("score"))))


@query(
    "fit3_missing_decides",
    "SELECT secs_since_prev_cust_txn IS NULL AS missing, count(*) AS rows, count(*) FILTER (WHERE secs_since_prev_cust_txn IS NULL) AS flagged FROM f GROUP BY 1",
    ("history",),
    _FEATURES,
)
def fit3_missing(spark, folder):
    """FIT-3: where a missing input decides the label, the trees find that side and make no error."""
    rows = _features(spark, folder).select(*FEATURES, F.col("secs_since_prev_cust_txn").isNull().alias("first")).checkpoint()
    inputs = [f for f in FEATURES if f == "secs_since_prev_cust_txn" or f not in scoring.NULLABLE]
    (model,) = boosting.fit_boosted(rows, [boosting.Setting(2, 3, 1.0)], [f for f in inputs if not f.startswith("cust_")], "first", step=1.0, columns=1.0)
    scored = rows.select("first", (model.score() >= 0.5).cast("int").alias("flag"))
    return scored.groupBy(F.col("first").alias("missing")).agg(F.count(F.lit(1)).alias("rows"), F.sum("flag").cast("bigint").alias("flagged"))


@query("fit4_configuration_grid", "SELECT family, TRUE AS is_best, TRUE AS ranks_well FROM later, (VALUES ('linear'), ('trees')) v(family)", ("history", "scored"), {"later": _LATER})
def fit4(spark, folder):
    """FIT-4: a grid of both families; the best of each by average precision on later rows."""
    train, later = _labelled(spark, folder)
    grid = fitting.linear_grid([1.0], [False, True]) + fitting.tree_grid([2], [3], [1.0, 10.0])
    scored = fitting.score_grid(train, later, grid, ["seq", "is_fraud"]).withColumn("fold", F.lit("later"))
    _, mean = ev.mean_over_folds(scored)
    mean = mean.checkpoint()
    highest = mean.groupBy("family").agg(F.max("mean_average_precision").alias("highest"))
    chance = later.agg(F.avg(F.col("is_fraud").cast("int"))).scalar()
    best = F.col("mean_average_precision") == F.col("highest")
    return ev.best_per_family(mean).join(highest, "family").select("family", best.alias("is_best"), (F.col("highest") > 3 * chance).alias("ranks_well"))
