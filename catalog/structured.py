"""Queries over the table operators, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.common import blank, blanked, round_columns, rounded, sql_round, table
from tabweave.operators import categorical, dates, evaluate, folds, missing, numeric, prune, scaling, selection
from tabweave.operators.profile import profile, profile_frame
from tabweave.plans.roles import Roles, col

QUERIES = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


# ---- profile and pruning

NULL_RULES = {"o_totalprice": "o_orderkey % 7 = 0", "o_orderpriority": "o_orderkey % 5 < 2", "o_custkey": "o_orderkey % 10 < 9"}


def holed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    for name, rule in NULL_RULES.items():
        df = blank(df, name, rule)
    return df


HOLED_ORDERS = (
    "h AS (SELECT o_orderkey, o_orderstatus, o_orderdate, "
    + ", ".join(blanked(c, r) for c, r in NULL_RULES.items())
    + " FROM orders)"
)


def _profile_row(name: str, kind: str) -> str:
    if kind == "numeric":
        low, skew = f"round(min({name})::DOUBLE, 6) + 0.0", sql_round(f"skewness({name})", 6)
    else:
        low = skew = "NULL::DOUBLE"
    return (
        f"SELECT '{name}' AS column_name, '{kind}' AS type_class, count(*) AS n_rows, "
        f"count(*) - count({name}) AS n_null, {sql_round(f'1 - count({name}) / count(*)', 6)} AS null_share, "
        f"count(DISTINCT {name}) AS n_distinct, {low} AS min_value, {skew} AS skew FROM h"
    )


ORDER_KINDS = {
    "o_orderkey": "numeric",
    "o_custkey": "numeric",
    "o_orderstatus": "categorical",
    "o_totalprice": "numeric",
    "o_orderdate": "timestamp_ntz",
    "o_orderpriority": "categorical",
}


@register(f"WITH {HOLED_ORDERS} " + " UNION ALL ".join(_profile_row(c, k) for c, k in ORDER_KINDS.items()))
def column_profile(spark, sf_dir):
    return round_columns(profile_frame(holed_orders(spark, sf_dir)), 6)


def _prune_row(name: str) -> str:
    return (
        f"SELECT '{name}' AS column_name, CASE WHEN count(DISTINCT {name}) = count(*) THEN 'all_unique' "
        f"WHEN count(DISTINCT {name}) <= 1 THEN 'constant' "
        f"WHEN 1 - count({name}) / count(*) > 0.5 THEN 'mostly_null' "
        f"WHEN count(DISTINCT {name}) / count(*) > 0.9 THEN 'near_unique' ELSE 'kept' END AS reason FROM p"
    )


@register(
    f"WITH {HOLED_ORDERS}, p AS (SELECT *, 5.0 AS fixed, CASE WHEN o_orderkey % 20 = 0 THEN -1 ELSE o_orderkey END AS nearly FROM h) "
    + " UNION ALL ".join(_prune_row(c) for c in [*ORDER_KINDS, "fixed", "nearly"])
)
def prune_decisions(spark, sf_dir):
    df = holed_orders(spark, sf_dir).withColumn("fixed", F.lit(5.0))
    df = df.withColumn("nearly", F.when(F.col("o_orderkey") % 20 == 0, F.lit(-1)).otherwise(F.col("o_orderkey")))
    reasons = prune.fit_prune(profile(df, exact=True))
    return spark.createDataFrame([(c, reasons.get(c, "kept")) for c in df.columns], "column_name string, reason string")


@register(
    f"WITH {HOLED_ORDERS} SELECT o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM h"
)
def prune_columns(spark, sf_dir):
    df = holed_orders(spark, sf_dir)
    return prune.drop_columns(df, prune.fit_prune(profile(df)))


@register("SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem")
def leak_and_duplicate_prune(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_discount",
        "l_tax",
        (F.col("l_discount") * 2).alias("twice_l_discount"),
        (F.col("l_quantity") + 1).alias("l_quantity"),
    )
    return prune.drop_leaks(prune.drop_duplicate_names(df), Roles("l_discount"))


@register(
    "SELECT l_orderkey, l_quantity, l_extendedprice, l_discount, 0.0::DOUBLE AS l_tax FROM lineitem"
)
def align_features(spark, sf_dir):
    train = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_tax", "l_quantity", "l_extendedprice", "l_discount")
    test = train.drop("l_tax").withColumn("extra", F.lit(1))
    return prune.align(train, test, Roles(None, ("l_orderkey",)))[1]


@register("SELECT l_discount, 0.0::DOUBLE AS absent, l_quantity, l_orderkey, l_returnflag FROM lineitem")
def conform_schema(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return prune.conform(df, ["l_discount", "absent", "l_quantity"], Roles("l_returnflag", ("l_orderkey",)))


@register("SELECT l_orderkey, l_quantity, l_discount FROM lineitem")
def split_target(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_returnflag")
    return prune.split_target(df, "l_returnflag")[0]


# ---- missing values

SEVENTH, TWO_FIFTHS, NINE_TENTHS = "o_orderkey % 7 = 0", "o_orderkey % 5 < 2", "o_orderkey % 10 < 9"


def _filled(df: DataFrame, keep=("o_orderkey",)) -> DataFrame:
    roles = Roles(None, keep)
    return missing.apply_missing(df, missing.fit_missing(df, roles))


@register(
    f"WITH h AS (SELECT o_orderkey, {blanked('o_totalprice', SEVENTH)} FROM orders) "
    "SELECT o_orderkey, coalesce(o_totalprice, (SELECT median(o_totalprice) FROM h)) AS o_totalprice FROM h"
)
def fill_median(spark, sf_dir):
    return _filled(blank(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", SEVENTH))


@register(
    f"WITH h AS (SELECT o_orderkey, {blanked('o_totalprice', TWO_FIFTHS)}, {blanked('o_orderstatus', TWO_FIFTHS)} FROM orders) "
    "SELECT o_orderkey, coalesce(o_totalprice, -999.0::DOUBLE) AS o_totalprice, coalesce(o_orderstatus, 'Missing') AS o_orderstatus, "
    "(o_totalprice IS NULL)::INT AS o_totalprice_is_missing, (o_orderstatus IS NULL)::INT AS o_orderstatus_is_missing FROM h"
)
def fill_flag_sentinel(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return _filled(blank(blank(df, "o_totalprice", TWO_FIFTHS), "o_orderstatus", TWO_FIFTHS))


@register(
    f"WITH h AS (SELECT o_orderkey, {blanked('o_orderpriority', SEVENTH)} FROM orders) "
    "SELECT o_orderkey, coalesce(o_orderpriority, 'Unknown') AS o_orderpriority FROM h"
)
def fill_unknown(spark, sf_dir):
    return _filled(blank(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", SEVENTH))


@register(
    f"WITH h AS (SELECT o_orderkey, {blanked('o_orderpriority', SEVENTH)}, {blanked('o_totalprice', TWO_FIFTHS)} FROM orders), "
    "m AS (SELECT o_orderpriority AS v FROM h WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) "
    "SELECT o_orderkey, coalesce(o_orderpriority, (SELECT v FROM m)) AS o_orderpriority, "
    "coalesce(o_totalprice, (SELECT median(o_totalprice) FROM h)) AS o_totalprice FROM h"
)
def fill_mode(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    df = blank(blank(df, "o_orderpriority", SEVENTH), "o_totalprice", TWO_FIFTHS)
    return missing.fill_own_statistics(df, Roles(None, ("o_orderkey",)))


@register("SELECT o_orderkey, o_totalprice FROM orders")
def drop_mostly_null(spark, sf_dir):
    df = blank(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", NINE_TENTHS)
    return missing.drop_null_above(df, Roles(None, ("o_orderkey",)))


# ---- numeric features

FOUR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PAIRS = [(a, b) for i, a in enumerate(FOUR) for b in FOUR[i + 1 :]]


@register(
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"{a} * {b} AS {a}_x_{b}, {a} / ({b} + 1e-8) AS {a}_div_{b}" for a, b in PAIRS)
    + " FROM lineitem"
)
def pairwise_product_ratio(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *numeric.pairwise(FOUR))


def _bins_sql(source: str, keys: str, name: str) -> str:
    return (
        f"WITH e AS (SELECT list_sort(list_distinct(quantile_cont({name}::DOUBLE, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS edges FROM {source}) "
        f"SELECT {keys}, {name}, greatest(len(list_filter(edges, lambda x: x < {name})) - 1, 0)::INT AS {name}_bin FROM {source}, e"
    )


def _binned(df: DataFrame, name: str, edges: list[float]) -> DataFrame:
    return df.select("*", numeric.bin_index(col(name), edges).alias(f"{name}_bin"))


@register(_bins_sql("events", "event_id", "value"))
def quantile_bins(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "value")
    return _binned(df, "value", numeric.quantile_edges(df, ["value"])["value"])


@register(_bins_sql("lineitem", "l_orderkey", "l_linenumber"))
def quantile_bins_merged(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return _binned(df, "l_linenumber", numeric.quantile_edges(df, ["l_linenumber"])["l_linenumber"])


@register(
    "WITH q AS (SELECT quantile_cont(o_totalprice, [0.1, 0.25, 0.5, 0.75, 0.9]) AS v FROM orders) "
    "SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9]::DOUBLE[]) AS share, round(unnest(v), 6) + 0.0 AS value FROM q"
)
def exact_quantiles(spark, sf_dir):
    """The bracketed path, forced by a small buffer."""
    from tabweave.functions.quantiles import quantiles

    shares = [0.1, 0.25, 0.5, 0.75, 0.9]
    found = quantiles(table(spark, sf_dir, "orders"), {"o_totalprice": shares}, buffer_values=1000)["o_totalprice"]
    return round_columns(spark.createDataFrame(list(zip(shares, found)), "share double, value double"), 6)


@register(
    "WITH e AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem) "
    "SELECT l_orderkey, l_quantity, CASE "
    + " ".join(f"WHEN l_quantity <= a + (b - a) * {k} / 5 THEN {k - 1}" for k in range(1, 5))
    + " ELSE 4 END AS l_quantity_bin FROM lineitem, e"
)
def equal_width_bins(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    return _binned(df, "l_quantity", numeric.equal_width_edges(df, ["l_quantity"])["l_quantity"])


@register(
    "SELECT event_id, round(CASE WHEN (SELECT min(value) > 0 AND skewness(value) > 1 FROM events) THEN ln(1 + value) END, 6) + 0.0 AS value_log FROM events"
)
def conditional_log(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "value")
    spec = numeric.fit_numeric(df, Roles(None, ("event_id",)))
    logs = [numeric.log_column(c) for c in spec["logs"]] or [F.lit(None).cast("double").alias("value_log")]
    return round_columns(df.select("event_id", *logs), 6)


@register("SELECT c_custkey, c_acctbal * c_acctbal AS c_acctbal_squared, sqrt(abs(c_acctbal)) AS c_acctbal_sqrt FROM customer")
def square_sqrt(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", numeric.square("c_acctbal"), numeric.root("c_acctbal"))


@register(
    f"WITH h AS (SELECT l_orderkey, l_linenumber, list_filter([l_quantity, l_extendedprice, l_discount, "
    "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_tax END], lambda x: x IS NOT NULL) AS v FROM lineitem) "
    f"SELECT l_orderkey, l_linenumber, {sql_round('list_avg(v)', 4)} AS row_mean, {sql_round('list_stddev_samp(v)', 4)} AS row_std, "
    f"{sql_round('list_sum(v)', 4)} AS row_sum FROM h"
)
def row_statistics(spark, sf_dir):
    df = blank(table(spark, sf_dir, "lineitem"), "l_tax", "l_orderkey % 7 = 0")
    made = numeric.add_row_statistics(df, FOUR)
    return round_columns(made.select("l_orderkey", "l_linenumber", "row_mean", "row_std", "row_sum"), 4)


# ---- categorical features and encoders

HOLED_PART = f"h AS (SELECT p_partkey, {blanked('p_brand', 'p_partkey % 7 = 0')} FROM part)"
BRAND_COUNTS = "f AS (SELECT p_brand AS v, count(*) AS n FROM h WHERE p_brand IS NOT NULL GROUP BY 1)"


def holed_part(spark, sf_dir):
    return blank(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey % 7 = 0")


@register(
    f"WITH {HOLED_PART}, {BRAND_COUNTS} SELECT p_partkey, p_brand, n::DOUBLE AS p_brand_freq FROM h LEFT JOIN f ON p_brand = v"
)
def frequency_feature(spark, sf_dir):
    df = holed_part(spark, sf_dir)
    return categorical.frequency_features(df, categorical.fit_lookups(df, ["p_brand"]), [])


@register(
    f"WITH {HOLED_PART}, {BRAND_COUNTS}, t AS (SELECT v FROM f ORDER BY n DESC, v LIMIT 1) "
    "SELECT p_partkey, p_brand, n::DOUBLE AS p_brand_freq, (p_brand IS DISTINCT FROM (SELECT v FROM t))::INT AS p_brand_is_rare "
    "FROM h LEFT JOIN f ON p_brand = v"
)
def rare_flag(spark, sf_dir):
    df = holed_part(spark, sf_dir)
    return categorical.frequency_features(df, categorical.fit_lookups(df, ["p_brand"]), ["p_brand"])


@register(
    "SELECT p_partkey, n::DOUBLE AS p_name_freq FROM part JOIN (SELECT p_name AS v, count(*) AS n FROM part GROUP BY 1) ON p_name = v"
)
def frequency_encoding(spark, sf_dir):
    """The shuffle path with hot values split off, forced by a zero broadcast limit."""
    from tabweave.operators.lookup import attach

    df = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    lookup = categorical.fit_lookups(df, ["p_name"])["p_name"]
    return attach(df, "p_name", lookup, {"p_name_freq": F.col("__n").cast("double")}, drop_key=True, broadcast_bytes=0)


@register(
    "WITH m AS (SELECT p_brand AS v, avg(p_retailprice) AS y FROM part GROUP BY 1), "
    "t AS (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN 'Brand#new' ELSE p_brand END AS p_brand FROM part) "
    f"SELECT p_partkey, {sql_round('coalesce(y, (SELECT avg(p_retailprice) FROM part))', 6)} AS p_brand_target_encoded FROM t LEFT JOIN m ON p_brand = v"
)
def target_encoding(spark, sf_dir):
    train = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    spec, lookups = categorical.fit_encoders(train, Roles("p_retailprice", ("p_partkey",)))
    new = F.when(F.col("p_partkey") % 50 == 0, F.lit("Brand#new")).otherwise(F.col("p_brand"))
    test = train.select("p_partkey", new.alias("p_brand"))
    return round_columns(categorical.apply_encoders(test, spec, lookups), 6)


@register(
    "WITH t AS (SELECT p_partkey, p_partkey % 5 AS fold, p_brand, p_retailprice AS y FROM part), "
    "own AS (SELECT p_brand, fold, count(*) AS n, sum(y) AS s FROM t GROUP BY 1, 2), "
    "total AS (SELECT p_brand, count(*) AS n, sum(y) AS s FROM t GROUP BY 1), "
    "folds AS (SELECT f.fold, avg(t.y) AS mean FROM (SELECT DISTINCT fold FROM t) f JOIN t ON t.fold <> f.fold GROUP BY 1) "
    f"SELECT p_partkey, y AS p_retailprice, {sql_round('coalesce((total.s - own.s) / nullif(total.n - own.n, 0), folds.mean)', 6)} AS p_brand_target_encoded, "
    f"{sql_round('total.s / total.n', 6)} AS scored "
    "FROM t JOIN own USING (p_brand, fold) JOIN total USING (p_brand) JOIN folds USING (fold)"
)
def target_encoding_folds(spark, sf_dir):
    """Training rows by the other folds, and the same rows as a later table would be scored."""
    train = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    fold = F.col("p_partkey") % 5
    spec, lookups = categorical.fit_encoders(train, Roles("p_retailprice", ("p_partkey",)), fold=fold)
    made = categorical.apply_encoders(train, spec, lookups, fold, "p_retailprice")
    later = categorical.apply_encoders(train.drop("p_retailprice"), spec, categorical.without_folds(lookups))
    both = made.join(later.select("p_partkey", F.col("p_brand_target_encoded").alias("scored")), "p_partkey")
    return round_columns(both, 6, ["p_brand_target_encoded", "scored"])


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register(
    "SELECT o_orderkey, "
    + ", ".join(f"(o_orderpriority = '{p}')::INT AS \"o_orderpriority_{p}\"" for p in PRIORITIES)
    + " FROM orders"
)
def one_hot(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    spec, lookups = categorical.fit_encoders(df, Roles(None, ("o_orderkey",)))
    return categorical.apply_encoders(df, spec, lookups)


@register(
    "SELECT o_orderkey, "
    + ", ".join(
        f"(o_orderpriority = '{p}' AND o_orderkey % 50 <> 0)::INT AS \"o_orderpriority_{p}\"" for p in PRIORITIES
    )
    + " FROM orders"
)
def one_hot_replay(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    spec, lookups = categorical.fit_encoders(df, Roles(None, ("o_orderkey",)))
    new = F.when(F.col("o_orderkey") % 50 == 0, F.lit("other")).otherwise(F.col("o_orderpriority"))
    return categorical.apply_encoders(df.withColumn("o_orderpriority", new), spec, lookups)


SEGMENT_CODES = "c AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT c_mktsegment AS v FROM customer))"


@register(f"WITH {SEGMENT_CODES} SELECT c_custkey, code::DOUBLE AS c_mktsegment FROM customer JOIN c ON c_mktsegment = v")
def label_encode(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return categorical.encode_labels(df, "c_mktsegment", categorical.fit_labels(df, "c_mktsegment"))


@register(
    f"WITH {SEGMENT_CODES}, t AS (SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN 'other' ELSE c_mktsegment END AS s FROM customer) "
    "SELECT c_custkey, coalesce(code, 0)::DOUBLE AS c_mktsegment FROM t LEFT JOIN c ON s = v"
)
def label_replay(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    classes = categorical.fit_labels(df, "c_mktsegment")
    new = F.when(F.col("c_custkey") % 50 == 0, F.lit("other")).otherwise(F.col("c_mktsegment"))
    return categorical.encode_labels(df.withColumn("c_mktsegment", new), "c_mktsegment", classes, unseen_to_first=True)


@register(
    "SELECT p_partkey, n::DOUBLE AS p_brand_freq_encoded, "
    + ", ".join(f"(p_type = '{t}')::INT AS p_type_{t}" for t in ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"])
    + " FROM part JOIN (SELECT p_brand AS v, count(*) AS n FROM part GROUP BY 1) ON p_brand = v"
)
def adhoc_encode(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return categorical.encode_adhoc(df, Roles(None, ("p_partkey",)), drop=("p_name",))


# ---- dates


@register(
    "WITH d AS (SELECT o_orderkey, try_cast(CASE WHEN o_orderkey % 11 = 0 THEN 'garbage' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS TIMESTAMP) AS t FROM orders) "
    "SELECT o_orderkey, year(t)::INT AS order_date_year, month(t)::INT AS order_date_month, day(t)::INT AS order_date_day, "
    "(isodow(t) - 1)::INT AS order_date_dayofweek FROM d"
)
def date_parts(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 11 == 0, F.lit("garbage")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    df = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("order_date"))
    return dates.apply_dates(df, dates.fit_dates(df, Roles(None, ("o_orderkey",))))


# ---- selection and scaling

SPREAD = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "copy", "price_and_tax"]


@register(
    "WITH d AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, 2 * l_quantity + 1 AS copy, l_extendedprice + 10 * l_tax AS price_and_tax FROM lineitem) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, ({' OR '.join([f'abs(corr({e}, {c})) > 0.95' for e in SPREAD[:j]] or ['bool_or(false)'])})::INT AS dropped FROM d"
        for j, c in enumerate(SPREAD)
    )
)
def correlation_prune(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        *FOUR,
        (2 * F.col("l_quantity") + 1).alias("copy"),
        (F.col("l_extendedprice") + 10 * F.col("l_tax")).alias("price_and_tax"),
    )
    gone = selection.fit_correlation_prune(df, SPREAD)
    return spark.createDataFrame([(c, int(c in gone)) for c in SPREAD], "column_name string, dropped int")


FIVE = ["l_linenumber", *FOUR]
DERIVED = {c: c for c in FIVE}
for _i, _a in enumerate(FIVE):
    for _b in FIVE[_i + 1 :]:
        DERIVED[f"{_a}_x_{_b}"] = f"{_a} * {_b}"
for _a in FIVE:
    DERIVED |= {f"{_a}_squared": f"{_a} * {_a}", f"{_a}_sqrt": f"sqrt(abs({_a}))", f"{_a}_inverse": f"1 / (1 + {_a})", f"{_a}_log": f"ln(1 + {_a})"}


def derived(spark, sf_dir, *others: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    return df.select(*others, *[F.expr(e).cast("double").alias(f"x_{name}") for name, e in DERIVED.items()])


WIDE = "w AS (SELECT l_returnflag, l_orderkey, " + ", ".join(f"({e})::DOUBLE AS x_{n}" for n, e in DERIVED.items()) + " FROM lineitem)"
BEST = 30


def _ranked(scores: str) -> str:
    return (
        f"SELECT feature, {sql_round('score', 4)} AS score, (row_number() OVER (ORDER BY score DESC, pos DESC) <= {BEST})::INT AS kept FROM ({scores})"
    )


def _anova_score(at: int, name: str) -> str:
    return (
        f"SELECT {at} AS pos, 'x_{name}' AS feature, (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))) AS score "
        f"FROM (SELECT count(*) AS n, avg(x_{name}) AS m, var_samp(x_{name}) AS v, (SELECT avg(x_{name}) FROM w) AS g FROM w GROUP BY l_returnflag)"
    )


def _scored(spark, scores: dict[str, float]) -> DataFrame:
    kept = selection.top_k(scores, selection.keep_count(len(scores)))
    rows = [(c, s, int(c in kept)) for c, s in scores.items()]
    return round_columns(spark.createDataFrame(rows, "feature string, score double, kept int"), 4)


@register(f"WITH {WIDE} " + _ranked(" UNION ALL ".join(_anova_score(i, n) for i, n in enumerate(DERIVED))))
def anova_topk(spark, sf_dir):
    df = derived(spark, sf_dir, "l_returnflag")
    return _scored(spark, selection.anova_scores(df, [f"x_{n}" for n in DERIVED], "l_returnflag"))


@register(
    f"WITH {WIDE} "
    + _ranked(
        " UNION ALL ".join(
            f"SELECT {i} AS pos, 'x_{n}' AS feature, power(corr(x_{n}, l_orderkey), 2) / (1 - power(corr(x_{n}, l_orderkey), 2)) * (count(*) - 2) AS score FROM w"
            for i, n in enumerate(DERIVED)
        )
    )
)
def f_regression_topk(spark, sf_dir):
    df = derived(spark, sf_dir, "l_orderkey")
    return _scored(spark, selection.regression_scores(df, [f"x_{n}" for n in DERIVED], "l_orderkey"))


def _constant(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *FOUR, F.lit(5.0).alias("fixed"))


@register(
    "WITH s AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FOUR)
    + " FROM lineitem) SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"{sql_round(f'({c} - m_{c}) / s_{c}', 6)} AS {c}" for c in FOUR)
    + ", 0.0::DOUBLE AS fixed FROM lineitem, s"
)
def standard_scale(spark, sf_dir):
    df = _constant(spark, sf_dir)
    return round_columns(scaling.apply_scale(df, scaling.fit_scale(df, [*FOUR, "fixed"], "standard")), 6)


@register(
    "WITH s AS (SELECT "
    + ", ".join(f"min({c}) AS m_{c}, max({c}) - min({c}) AS s_{c}" for c in FOUR)
    + " FROM lineitem) SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"{sql_round(f'({c} - m_{c}) / s_{c}', 6)} AS {c}" for c in FOUR)
    + ", 0.0::DOUBLE AS fixed FROM lineitem, s"
)
def minmax_scale(spark, sf_dir):
    df = _constant(spark, sf_dir)
    return round_columns(scaling.apply_scale(df, scaling.fit_scale(df, [*FOUR, "fixed"], "minmax")), 6)


# ---- folds and evaluation


@register(
    "SELECT o_orderkey, o_orderstatus, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) % 3)::INT AS fold FROM orders"
)
def cv_folds_stratified(spark, sf_dir):
    return folds.add_folds(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 3, "o_orderstatus")


@register("SELECT o_orderkey, (ntile(7) OVER (ORDER BY o_orderkey) - 1)::INT AS fold FROM orders")
def cv_folds_contiguous(spark, sf_dir):
    return folds.add_folds(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 7)


GUESS = "CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END"
REPORT = f"""
WITH g AS (SELECT l_returnflag AS y, {GUESS} AS p FROM lineitem),
c AS (SELECT y AS k FROM g UNION SELECT p FROM g),
s AS (SELECT k, (SELECT count(*) FROM g WHERE y = k) AS support, (SELECT count(*) FROM g WHERE p = k) AS predicted,
  (SELECT count(*) FROM g WHERE y = k AND p = k) AS hit FROM c),
m AS (SELECT k, support, hit, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0 END AS pr,
  CASE WHEN support > 0 THEN hit / support ELSE 0 END AS re,
  CASE WHEN predicted + support > 0 THEN 2 * hit / (predicted + support) ELSE 0 END AS f FROM s)
SELECT k AS class, {sql_round("pr", 6)} AS precision, {sql_round("re", 6)} AS recall, {sql_round("f", 6)} AS f1, support::BIGINT AS support FROM m
UNION ALL SELECT 'accuracy', {sql_round("sum(hit) / sum(support)", 6)}, {sql_round("sum(hit) / sum(support)", 6)}, {sql_round("sum(hit) / sum(support)", 6)}, sum(support)::BIGINT FROM m
UNION ALL SELECT 'macro avg', {sql_round("avg(pr)", 6)}, {sql_round("avg(re)", 6)}, {sql_round("avg(f)", 6)}, sum(support)::BIGINT FROM m
UNION ALL SELECT 'weighted avg', {sql_round("sum(pr * support) / sum(support)", 6)}, {sql_round("sum(re * support) / sum(support)", 6)}, {sql_round("sum(f * support) / sum(support)", 6)}, sum(support)::BIGINT FROM m
"""


@register(REPORT)
def classification_report(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("y"), F.expr(GUESS).alias("p"))
    return round_columns(evaluate.classification_report(df, "y", "p"), 6)


@register(f"SELECT {sql_round(f'avg((l_returnflag = {GUESS})::INT)', 6)} AS accuracy FROM lineitem")
def accuracy_score(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("y"), F.expr(GUESS).alias("p"))
    return round_columns(evaluate.accuracy(df, "y", "p"), 6)


@register(
    "WITH g AS (SELECT l_extendedprice AS y, 1500 * l_quantity AS p FROM lineitem) "
    f"SELECT {sql_round('avg((y - p) * (y - p))', 2)} AS mse, {sql_round('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))', 6)} AS r2 FROM g"
)
def regression_metrics(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("y"), (1500 * F.col("l_quantity")).alias("p"))
    return round_columns(round_columns(evaluate.regression_metrics(df, "y", "p"), 2, ["mse"]), 6, ["r2"])


@register("SELECT l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY 1")
def target_summary_classes(spark, sf_dir):
    return evaluate.target_summary(table(spark, sf_dir, "lineitem"), "l_returnflag", "classification")


@register("SELECT min(p_retailprice) AS low, max(p_retailprice) AS high FROM part")
def target_summary_range(spark, sf_dir):
    return evaluate.target_summary(table(spark, sf_dir, "part"), "p_retailprice", "regression")
