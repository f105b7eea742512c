"""Registered queries of the library's operators over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions import expressions as X
from tabloom.functions import tokenizers
from tabloom.operators import cluster, codecs, detect, records, relational, sampling, sequences, stats
from tabloom.plans import synthesizers
from tabloom.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return files.read_table(spark, f"{sf_dir}/{name}.parquet")


def r6(name: str, out: str | None = None):
    return F.round(name, 6).alias(out or name)


def halves(spark: SparkSession, d: str, *names: str) -> tuple[DataFrame, DataFrame]:
    """Even order keys as training, odd ones as synthetic: together all rows."""
    t = table(spark, d, "lineitem")
    return t.where("l_orderkey % 2 = 0").select(*names), t.where("l_orderkey % 2 <> 0").select(*names)


def gaps(spark: SparkSession, d: str) -> DataFrame:
    """events with missing values."""
    return table(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 7 < 3, None).otherwise(F.col("value")))


GAPS = "(SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 7 < 3 THEN NULL ELSE value END AS value FROM events)"


def bins_sql(c: str) -> str:
    return f"""u AS (SELECT {c} AS x FROM lineitem WHERE l_orderkey % 2 = 0 UNION ALL SELECT {c} FROM lineitem WHERE l_orderkey % 2 <> 0),
m AS (SELECT avg(x) AS m, count(x) AS n, min(x) AS lo, max(x) AS hi FROM u),
s AS (SELECT any_value(n) AS n, any_value(lo)::DOUBLE AS lo, any_value(hi)::DOUBLE AS hi, avg(pow(x - m, 3)) / pow(avg(pow(x - m, 2)), 1.5) AS g FROM u, m),
b AS (SELECT n, lo, hi, CAST(ceil((hi - lo) / ((hi - lo) / (1 + log2(n) + log2(1 + abs(g) / sqrt(6.0::DOUBLE * (n - 2) / ((n + 1.0::DOUBLE) * (n + 3))))))) AS INTEGER) AS bins FROM s)"""


def mass_sql(c: str, where: str) -> str:
    return f"SELECT greatest(1, least(bins, ceil(({c} - lo) / ((hi - lo) / bins))))::INTEGER AS bin, count(*) * 1.0::DOUBLE / (SELECT count(*) FROM lineitem WHERE {where}) AS mass FROM lineitem, b WHERE {where} GROUP BY 1"


def jsd_sql(p: str, q: str) -> str:
    """Distance of two (k, w) selects."""
    return f"""(WITH p AS ({p}), q AS ({q}), j AS (SELECT coalesce(p.w, 0) / (SELECT sum(w) FROM p) AS p, coalesce(q.w, 0) / (SELECT sum(w) FROM q) AS q FROM p FULL JOIN q ON p.k = q.k)
SELECT sqrt(greatest(sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2), 0)) FROM j)"""


# ---------------------------------------------------------------- statistics


@query("SELECT CAST(sum((event_id % 7 < 3)::INT + (event_id % 11 = 0)::INT) AS BIGINT) AS missing FROM events")
def count_missing(spark: SparkSession, d: str) -> DataFrame:
    return stats.count_missing(gaps(spark, d).withColumn("props", F.when(F.col("event_id") % 11 == 0, None).otherwise(F.col("props"))))


@query("SELECT l_returnflag AS key, round(count(*) * 100::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM lineitem GROUP BY 1")
def cat_distribution(spark: SparkSession, d: str) -> DataFrame:
    return stats.categorical_distribution(table(spark, d, "lineitem"), "l_returnflag").select("key", r6("share"))


@query(f"WITH {bins_sql('l_discount')} SELECT n AS n_values, lo AS low, hi AS high, bins FROM b")
def numeric_bins(spark: SparkSession, d: str) -> DataFrame:
    return stats.shared_bins(*halves(spark, d, "l_discount"), "l_discount")


@query(f"WITH {bins_sql('l_discount')} SELECT bin, round(mass, 6) AS mass FROM ({mass_sql('l_discount', 'l_orderkey % 2 = 0')})")
def numeric_distribution(spark: SparkSession, d: str) -> DataFrame:
    a, b = halves(spark, d, "l_discount")
    return stats.binned_distribution(a, "l_discount", stats.shared_bins(a, b, "l_discount")).select("bin", r6("mass"))


TEXTS, NUMBERS = ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def js_sql() -> str:
    out = [f"SELECT '{c}' AS \"column\", 'categorical' AS kind, round({jsd_sql(f'SELECT {c} AS k, count(*) AS w FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1', f'SELECT {c} AS k, count(*) AS w FROM lineitem WHERE l_orderkey % 2 <> 0 GROUP BY 1')}, 6) AS distance" for c in TEXTS]
    for c in NUMBERS:
        p, q = (f"SELECT bin AS k, mass AS w FROM ({mass_sql(c, w)})" for w in ("l_orderkey % 2 = 0", "l_orderkey % 2 <> 0"))
        out.append(f"SELECT * FROM (WITH {bins_sql(c)} SELECT '{c}' AS \"column\", 'numeric' AS kind, round({jsd_sql(p, q)}, 6) AS distance)")
    return " UNION ALL ".join(out)


@query(js_sql())
def js_distance(spark: SparkSession, d: str) -> DataFrame:
    a, b = halves(spark, d, *TEXTS, *NUMBERS)
    return stats.distances(a, b, [*TEXTS, *NUMBERS]).select("column", "kind", r6("distance"))


@query("SELECT 'l_returnflag' AS \"column\", 'categorical' AS kind, 0.5887::DOUBLE AS distance")
def js_fallback(spark: SparkSession, d: str) -> DataFrame:
    a, b = halves(spark, d, "l_returnflag")
    return stats.column_distance(a, b.where("false"), "l_returnflag")


@query(" UNION ALL ".join(f"SELECT '{a}' AS row_col, '{b}' AS col_col, {'1.0::DOUBLE' if a == b else f'round(corr({a}, {b}), 6)'} AS value FROM {'(SELECT 1)' if a == b else 'lineitem'}" for a in NUMBERS for b in NUMBERS))
def pearson_matrix(spark: SparkSession, d: str) -> DataFrame:
    return stats.pearson_matrix(table(spark, d, "lineitem"), NUMBERS).select("row_col", "col_col", r6("value"))


def eta_sql(t: str, c: str, y: str) -> str:
    return f"(SELECT sqrt(sum(n * pow(m - g, 2)) / any_value(sst)) FROM (SELECT count(*) AS n, avg({y}) AS m FROM {t} GROUP BY {c}), (SELECT avg({y}) AS g, var_pop({y}) * count(*) AS sst FROM {t}))"


def u_sql(t: str, x: str, y: str) -> str:
    """U(x given y)."""
    return f"(SELECT (hx - hxy) / hx FROM (SELECT -sum(p * ln(p)) AS hx FROM (SELECT count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM {t} GROUP BY {x})), (SELECT -sum(p * ln(p / py)) AS hxy FROM (SELECT n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY y) / sum(n) OVER () AS py FROM (SELECT {x} AS x, {y} AS y, count(*)::DOUBLE AS n FROM {t} GROUP BY 1, 2))))"


@query(f"SELECT round({eta_sql('lineitem', 'l_returnflag', 'l_extendedprice')}, 6) AS value")
def correlation_ratio(spark: SparkSession, d: str) -> DataFrame:
    return stats.correlation_ratio(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice").select(r6("value"))


@query(" UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, round({u_sql('orders', x, y)}, 6) AS value" for x, y in (("o_orderstatus", "o_orderpriority"), ("o_orderpriority", "o_orderstatus"))))
def theils_u(spark: SparkSession, d: str) -> DataFrame:
    return stats.theils_u(table(spark, d, "orders"), [("o_orderstatus", "o_orderpriority"), ("o_orderpriority", "o_orderstatus")]).select("x", "y", r6("value"))


MIXED = "(SELECT o_orderkey AS id, o_orderstatus AS s, o_orderpriority AS p, floor(o_totalprice / 1000) AS price, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS cust, 1 AS one FROM orders)"


def mixed_sql() -> str:
    names = ["id", "s", "p", "price", "cust", "one"]
    cells = {}
    for a in names:
        for b in names:
            if a == b:
                v = "1.0"
            elif "one" in (a, b):
                v = "0.0"
            elif a in "sp" and b in "sp":
                v = u_sql(MIXED, b, a)
            elif {a, b} & {"s", "p"} and {a, b} & {"price", "cust", "id"}:
                c, y = (a, b) if a in "sp" else (b, a)
                v = eta_sql(f"(SELECT * FROM {MIXED} WHERE {y} IS NOT NULL)", c, y)
            else:
                v = f"(SELECT corr({a}, {b}) FROM {MIXED})"
            cells[a, b] = v
    return " UNION ALL ".join(f"SELECT '{a}' AS row_col, '{b}' AS col_col, round(({v})::DOUBLE, 6) AS value" for (a, b), v in cells.items())


@query(mixed_sql())
def correlation_matrix(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    mixed = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"), F.floor(F.col("o_totalprice") / 1000).alias("price"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey")).alias("cust"), F.lit(1).alias("one"))
    return stats.correlation_matrix(mixed).select("row_col", "col_col", r6("value"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, round(count(DISTINCT {c})::DOUBLE / count(*), 6) AS ratio FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")))
def uniqueness_profile(spark: SparkSession, d: str) -> DataFrame:
    return stats.uniqueness(table(spark, d, "customer")).select("column", "n_distinct", r6("ratio"))


NORMAL = "(SELECT c_custkey, coalesce(b, (SELECT median(CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END) FROM customer)) AS bal, count(*) OVER (PARTITION BY c_mktsegment)::DOUBLE AS seg FROM (SELECT *, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS b FROM customer))"


@query(f"SELECT c_custkey, round((bal - avg(bal) OVER ()) / stddev_pop(bal) OVER (), 6) AS c_acctbal, round((seg - avg(seg) OVER ()) / stddev_pop(seg) OVER (), 6) AS c_mktsegment FROM {NORMAL}")
def normalize_dataset(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("c_acctbal"), "c_mktsegment")
    return stats.normalise(c, keep=["c_custkey"]).select("c_custkey", r6("c_acctbal"), r6("c_mktsegment"))


@query("""WITH z AS (SELECT o_orderkey, (o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER () AS a, (o_custkey - avg(o_custkey) OVER ()) / stddev_pop(o_custkey) OVER () AS b FROM orders), r AS (SELECT corr(a, b) AS r FROM z)
SELECT o_orderkey, round(abs((CASE WHEN r >= 0 THEN a + b ELSE a - b END) / sqrt(2)), 4) AS pc1, round(abs((CASE WHEN r >= 0 THEN a - b ELSE a + b END) / sqrt(2)), 4) AS pc2 FROM z, r""")
def pca_2d(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    return stats.pca(o, 2, keep=["o_orderkey"]).select("o_orderkey", *[F.round(F.abs(c), 4).alias(c) for c in ("pc1", "pc2")])


@query("SELECT l_shipdate AS value, n FROM (SELECT l_shipdate, count(*) AS n, max(count(*)) OVER () AS top FROM lineitem GROUP BY 1) WHERE n = top")
def modes(spark: SparkSession, d: str) -> DataFrame:
    return stats.modes(table(spark, d, "lineitem"), "l_shipdate")


# ---------------------------------------------------------------- rows of two tables

EVEN, THIRD = "SELECT o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0", "SELECT o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 2 <> 0"


def order_parts(spark: SparkSession, d: str, null: bool = False) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders")
    if null:
        o = o.withColumn("o_custkey", F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")))
    return tuple(o.where(f"o_orderkey % 2 {is_} 0").select("o_custkey", "o_orderstatus", "o_orderpriority") for is_ in ("=", "<>"))


@query(f"SELECT count(*) AS memorized FROM ({EVEN} INTERSECT {THIRD})")
def memorized_rows(spark: SparkSession, d: str) -> DataFrame:
    return relational.count_memorized(*order_parts(spark, d))


@query(" ".join(f"SELECT count(*) AS memorized FROM ({EVEN} INTERSECT {THIRD})".replace("SELECT o_custkey", "SELECT CASE WHEN o_custkey % 5 <> 0 THEN o_custkey END").split()))
def memorized_rows_nulls(spark: SparkSession, d: str) -> DataFrame:
    return relational.count_memorized(*order_parts(spark, d, null=True))


@query(f"SELECT count(*) AS memorized FROM ({EVEN} INTERSECT {THIRD})")
def memorized_rows_mixed_types(spark: SparkSession, d: str) -> DataFrame:
    a, b = order_parts(spark, d)
    return relational.count_memorized(a, b.withColumn("o_custkey", F.col("o_custkey").cast("string")))


@query(f"{THIRD} EXCEPT {EVEN}")
def novel_rows(spark: SparkSession, d: str) -> DataFrame:
    return relational.novel_rows(*order_parts(spark, d))


@query("SELECT coalesce(a.k, b.k) AS o_custkey, CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' ELSE 'both' END AS side FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 2 = 0) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 2 <> 0) b ON a.k = b.k")
def outer_indicator(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return relational.outer_indicator(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 <> 0"), ["o_custkey"])


@query("""SELECT query_id, neighbour_id, rank, round(distance, 6) AS distance FROM (SELECT a.p_partkey AS query_id, b.p_partkey AS neighbour_id, sqrt(pow(a.p_size - b.p_size, 2) + pow(a.p_retailprice - b.p_retailprice, 2)) AS distance,
row_number() OVER (PARTITION BY a.p_partkey ORDER BY sqrt(pow(a.p_size - b.p_size, 2) + pow(a.p_retailprice - b.p_retailprice, 2)), b.p_partkey)::INTEGER AS rank FROM part a, part b WHERE a.p_partkey % 50 = 0 AND a.p_partkey <> b.p_partkey) WHERE rank <= 5""")
def knn_neighbors(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.array(F.col("p_size").cast("double"), "p_retailprice").alias("v"))
    return relational.nearest(p.where("p_partkey % 50 = 0"), p, "p_partkey", "v").select("query_id", "neighbour_id", "rank", r6("distance"))


@query("SELECT r_regionkey, r_name FROM region, range(2) UNION ALL SELECT r_regionkey, r_name FROM (SELECT * FROM region ORDER BY r_regionkey LIMIT 2)")
def upsample(spark: SparkSession, d: str) -> DataFrame:
    return relational.upsample(table(spark, d, "region"), 12, "r_regionkey")


@query("SELECT column_name AS \"column\", (ntile(3) OVER (ORDER BY pos) - 1)::INTEGER AS batch FROM (VALUES (1, 'l_orderkey'), (2, 'l_partkey'), (3, 'l_suppkey'), (4, 'l_linenumber'), (5, 'l_quantity'), (6, 'l_extendedprice'), (7, 'l_discount'), (8, 'l_tax'), (9, 'l_returnflag'), (10, 'l_linestatus'), (11, 'l_shipdate')) v(pos, column_name)")
def column_batches(spark: SparkSession, d: str) -> DataFrame:
    groups = relational.column_batches(table(spark, d, "lineitem").columns, 4)
    return spark.createDataFrame([(c, i) for i, g in enumerate(groups) for c in g], "column string, batch int")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 100::DOUBLE ELSE o_totalprice END AS o_totalprice, 'F' AS o_orderstatus FROM orders")
def fill_and_force(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")).alias("o_totalprice"), "o_orderstatus")
    return relational.force_values(relational.project(o.na.fill({"o_totalprice": 100.0}), ["o_orderkey", "o_totalprice", "o_orderstatus"]), {"o_orderstatus": "F"})


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def split_and_reassemble(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return relational.reassemble(relational.vertical_split(c, "c_custkey", 2), "c_custkey", c.columns)


@query("SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS a, o_totalprice AS b FROM orders")
def integers_where_possible(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("a"), F.col("o_totalprice").alias("b"))
    return relational.integers_where_possible(o, ["a", "b"])


# ---------------------------------------------------------------- detection and columns


@query(f"""SELECT 'c_name' AS "column", count(DISTINCT c_name)::DOUBLE / count(*) >= 0.85 AND avg(length(c_name)) - 1 >= 16 AND bool_and(regexp_full_match(c_name, '[A-Za-z0-9_-]*')) AS is_complex_id FROM customer
UNION ALL SELECT 'padded', count(DISTINCT c_custkey)::DOUBLE / count(*) >= 0.85 AND avg(length(concat('id-', lpad(c_custkey::VARCHAR, 16, '0')))) - 1 >= 16 FROM customer UNION ALL SELECT 'c_mktsegment', false""")
def complex_id_columns(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", F.concat(F.lit("id-"), F.lpad(F.col("c_custkey").cast("string"), 16, "0")).alias("padded"))
    return cluster.complex_ids(c, "c_custkey")


@query("SELECT round(avg(length(n_nationkey::VARCHAR) + length(n_name) + length(n_regionkey::VARCHAR)) + 2, 6) AS length FROM nation")
def avg_record_length(spark: SparkSession, d: str) -> DataFrame:
    return cluster.record_length(table(spark, d, "nation")).select(r6("length"))


STYLES = {"us": ("MM/dd/yyyy", "%m/%d/%Y"), "iso": ("yyyy-MM-dd", "%Y-%m-%d"), "named": ("MMM d yyyy", "%b %d %Y"), "full": ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %X")}


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{f}' AS format" for c, (_, f) in STYLES.items()))
def detect_datetime(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(*[F.date_format("o_orderdate", p).alias(c) for c, (p, _) in STYLES.items()], "o_orderpriority")
    return detect.detect_datetimes(o)


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{f}' AS format" for c, (_, f) in STYLES.items()))
def detect_datetime_match_all(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(*[F.date_format("o_orderdate", p).alias(c) for c, (p, _) in STYLES.items()], "o_orderpriority")
    return detect.detect_datetimes(o, match_all=True)


@query("SELECT event_id, round(coalesce(x, avg(x) OVER ()) / 1e6, 3) AS seconds, x IS NULL AS missing FROM (SELECT event_id, CASE WHEN event_id % 7 < 3 THEN NULL ELSE epoch_us(ts) END::DOUBLE AS x FROM events)")
def mean_impute_datetime(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 >= 3, F.col("ts")).alias("ts"))
    return detect.mean_imputed(e, "ts", "event_id").select("event_id", F.round(F.col("micros") / 1e6, 3).alias("seconds"), "missing")


@query("SELECT 'nothing' AS \"column\", true AS is_empty UNION ALL SELECT 'r_name', false")
def empty_columns(spark: SparkSession, d: str) -> DataFrame:
    return detect.empty_columns(table(spark, d, "region").select("r_name", F.lit(None).cast("double").alias("nothing")))


@query("SELECT 'c_mktsegment' AS \"column\", false AS continuous UNION ALL SELECT 'c_acctbal', true UNION ALL SELECT 'text', true")
def continuous_columns(spark: SparkSession, d: str) -> DataFrame:
    return detect.continuous_columns(table(spark, d, "customer").select("c_mktsegment", "c_acctbal", F.col("c_acctbal").cast("string").alias("text")))


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 3 DAY, '%m/%d/%Y') AS shifted, regexp_replace(strftime(o_orderdate, '%m/%d/%Y'), '[^/.\\- ,TZ+]', '#', 'g') AS mask FROM orders")
def date_shift_and_mask(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.date_format(X.shift_time(F.col("o_orderdate"), days=3), "MM/dd/yyyy").alias("shifted"), X.date_mask(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("mask"))


@query("SELECT " + ", ".join(f"(SELECT min(d)::INTEGER FROM range(0, 15) t(d) WHERE (SELECT bool_and({c} = round_even({c}, d::INTEGER)) FROM lineitem)) AS {c}" for c in ("l_extendedprice", "l_quantity", "l_discount")))
def rounding_digits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(*[codecs.rounding_digits(F.col(c)).alias(c) for c in ("l_extendedprice", "l_quantity", "l_discount")])


@query("SELECT bool_and(quality IN (0, 1)) AS quality, bool_and(toxic IN (0, 1)) AS toxic, bool_and(doc_id IN (0, 1)) AS doc_id FROM labels")
def binary_valued(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").agg(*[codecs.binary_valued(F.col(c)).alias(c) for c in ("quality", "toxic", "doc_id")])


# ---------------------------------------------------------------- encoders

DICT = "(SELECT v, (row_number() OVER (ORDER BY f, v) - 1)::INTEGER AS o FROM (SELECT {c} AS v, min({k}) AS f FROM {t} GROUP BY 1))"
SEGMENTS = DICT.format(c="c_mktsegment", k="c_custkey", t="customer")
NATIONS = DICT.format(c="n_name", k="n_nationkey", t="nation")


@query(f"SELECT v AS value, o AS ordinal FROM {DICT.format(c='o_orderpriority', k='o_orderkey', t='orders')}")
def ordinal_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return codecs.dictionary(table(spark, d, "orders"), "o_orderpriority", "o_orderkey")


@query(f"SELECT c_custkey, list_transform(range(0, (SELECT count(*) FROM {SEGMENTS})), lambda i: (i = o)::INTEGER)::VARCHAR AS code FROM customer JOIN {SEGMENTS} ON v = c_mktsegment")
def onehot_encode(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return codecs.OneHotCodec("c_mktsegment").fit(c, "c_custkey").encode(c).select("c_custkey", F.concat(F.lit("["), F.array_join(F.transform("c_mktsegment", lambda x: x.cast("string")), ", "), F.lit("]")).alias("code"))


@query("SELECT c_custkey, c_mktsegment FROM customer")
def onehot_decode(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    codec = codecs.OneHotCodec("c_mktsegment").fit(c, "c_custkey")
    return codec.decode(codec.encode(c))


@query(f"SELECT n_nationkey, list_transform(range(0, 5), lambda i: ((o + 1) >> (4 - i)::INTEGER) & 1)::VARCHAR AS code FROM nation JOIN {NATIONS} ON v = n_name")
def binary_encode(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return codecs.BinaryCodec("n_name").fit(n, "n_nationkey").encode(n).select("n_nationkey", F.concat(F.lit("["), F.array_join(F.transform("n_name", lambda x: x.cast("string")), ", "), F.lit("]")).alias("code"))


@query("SELECT n_nationkey, n_name FROM nation")
def binary_decode(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    codec = codecs.BinaryCodec("n_name").fit(n, "n_nationkey")
    return codec.decode(codec.encode(n))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 <> 0 THEN (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) ELSE o_orderpriority END AS o_orderpriority FROM orders")
def binary_decode_mode(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    codec = codecs.BinaryCodec("o_orderpriority").fit(o, "o_orderkey")
    broken = codec.encode(o).withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 2 != 0, F.array_repeat(F.lit(0), codec.bits)).otherwise(F.col("o_orderpriority")))
    return codec.decode(broken)


@query("SELECT c_custkey, c_acctbal, CAST(NULL AS DOUBLE) AS nothing FROM customer")
def float_and_empty_round_trip(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.lit(None).cast("double").alias("nothing"))
    t = codecs.TableCodec("c_custkey", continuous="float", chosen={"c_custkey": "float"}).fit(c)
    return t.decode(t.encode(c))


@query(f"SELECT c_custkey, concat(repeat('0', o), '1', repeat('0', 4 - o), repeat('0', 24 - n), '1', repeat('0', n)) AS vector FROM (SELECT c_custkey, o, 24 - c_nationkey AS n FROM customer JOIN {SEGMENTS} ON v = c_mktsegment)")
def condition_vector(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    coded = codecs.with_ordinal(c, "c_mktsegment", codecs.dictionary(c, "c_mktsegment", "c_custkey"))
    v = sampling.condition_vector([5, 25], {0: F.col("ordinal"), 1: F.col("c_nationkey")})
    return coded.select("c_custkey", F.array_join(F.transform(v, lambda x: x.cast("string")), "").alias("vector"))


# ---------------------------------------------------------------- sequences


def scale_sql(s: bool) -> str:
    u = "(value - lo) / greatest(hi - lo, 1e-6)"
    return f"SELECT event_id, round({f'{u} * 2 - 1' if s else u}, 6) AS value FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)"


@query(scale_sql(False))
def minmax_scale(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    low, high = sequences.min_max(e, "value")
    return e.select("event_id", F.round(sequences.scale(F.col("value"), F.lit(low), F.lit(high)), 6).alias("value"))


@query("SELECT event_id, round(value, 6) AS value FROM events")
def minmax_inverse(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    low, high = sequences.min_max(e, "value")
    both = sequences.unscale(sequences.scale(F.col("value"), F.lit(low), F.lit(high), True), F.lit(low), F.lit(high), True)
    return e.select("event_id", F.round(both, 6).alias("value"))


@query("""WITH g AS (SELECT min(value) AS lo, max(value) AS hi FROM events), x AS (SELECT event_id, user_id, (value - lo) / greatest(hi - lo, 1e-6) AS x FROM events, g), e AS (SELECT *, min(x) OVER (PARTITION BY user_id) AS a, max(x) OVER (PARTITION BY user_id) AS b FROM x)
SELECT event_id, round((x - a) / greatest(b - a, 1e-6), 5) AS value, round((a + b) / 2, 6) AS value_midpoint, round((b - a) / 2, 6) AS value_half_range FROM e""")
def two_level_scale(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    out = sequences.two_level_scale(e, "user_id", "value", *sequences.min_max(e, "value"))
    return out.select("event_id", F.round("value", 5).alias("value"), r6("value_midpoint"), r6("value_half_range"))


@query("SELECT event_id, round(value, 4) AS value FROM events")
def two_level_round_trip(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    low, high = sequences.min_max(e, "value")
    out = sequences.two_level_unscale(sequences.two_level_scale(e, "user_id", "value", low, high), "value", low, high)
    return out.select("event_id", F.round("value", 4).alias("value"))


RUNS = f"(SELECT user_id, max(n) AS run FROM (SELECT user_id, i, sum((value IS NULL)::INT)::BIGINT AS n FROM (SELECT *, count(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS i FROM {GAPS}) GROUP BY 1, 2) GROUP BY 1)"


@query(f"SELECT user_id, run FROM {RUNS}")
def longest_null_run(spark: SparkSession, d: str) -> DataFrame:
    return sequences.longest_null_run(gaps(spark, d).withColumn("o", F.struct("ts", "event_id")), "user_id", "o", "value")


SPARSE = "(SELECT event_id, ts, user_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS value FROM events)"


@query(f"SELECT user_id, ratio < 0.1 AND run < greatest(2, least(5, n * 0.05)) AS valid FROM (SELECT user_id, avg((value IS NULL)::INT) AS ratio, count(*) AS n FROM {SPARSE} GROUP BY 1) JOIN {RUNS.replace(GAPS, SPARSE)} USING (user_id)")
def example_validity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 13 != 0, F.col("value"))).withColumn("o", F.struct("ts", "event_id"))
    return sequences.example_validity(e, "user_id", "o", ["value"])


@query(f"""WITH e AS (SELECT *, row_number() OVER w AS rn FROM {GAPS} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), k AS (SELECT event_id, user_id, rn, value,
last_value(value IGNORE NULLS) OVER b AS v0, first_value(value IGNORE NULLS) OVER f AS v1, last_value(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS) OVER b AS p0, first_value(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS) OVER f AS p1 FROM e
WINDOW b AS (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(coalesce(value, v0 + (v1 - v0) * (rn - p0) / (p1 - p0), v0, v1), 6) AS value FROM k""")
def interpolate(spark: SparkSession, d: str) -> DataFrame:
    return sequences.interpolate(gaps(spark, d).withColumn("o", F.struct("ts", "event_id")), "user_id", "o", "value").select("event_id", r6("value"))


@query("SELECT event_id, (r2 // 20)::BIGINT AS example_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS r2 FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS r, count(*) OVER () AS n FROM events) WHERE r < n // 20 * 20)")
def autosplit(spark: SparkSession, d: str) -> DataFrame:
    return sequences.autosplit(table(spark, d, "events"), "event_id", 20, "ts").select("event_id", "example_id")


STEPS = "SELECT user_id, string_agg(event_type, '|' ORDER BY ts, event_id) AS types, count(*)::INTEGER AS length FROM events GROUP BY 1"


@query(STEPS)
def long_to_sequences(spark: SparkSession, d: str) -> DataFrame:
    s = sequences.long_to_sequences(table(spark, d, "events"), "user_id", "ts", ["event_id", "event_type", "value"])
    return s.select("user_id", F.array_join(F.transform("steps", lambda x: x["event_type"]), "|").alias("types"), "length")


@query("SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS pos, event_type, value FROM events")
def sequences_to_long(spark: SparkSession, d: str) -> DataFrame:
    s = sequences.long_to_sequences(table(spark, d, "events"), "user_id", "ts", ["event_id", "event_type", "value"])
    return sequences.sequences_to_long(s, "user_id", ["event_type", "value"])


MONTHLY = "(SELECT o_orderpriority, month(o_orderdate) AS m, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2)"


def monthly(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("m", F.month("o_orderdate"))
    return o.groupBy("o_orderpriority", "m").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


MONTHS = list(range(1, 13))


@query("SELECT o_orderpriority, " + ", ".join(f'max(CASE WHEN m = {m} THEN total END) AS "{m}"' for m in MONTHS) + f" FROM {MONTHLY} GROUP BY 1")
def long_to_wide(spark: SparkSession, d: str) -> DataFrame:
    return sequences.long_to_wide(monthly(spark, d), ["o_orderpriority"], "m", "total", MONTHS)


@query(f"SELECT o_orderpriority, m::VARCHAR AS t, total AS value FROM {MONTHLY}")
def wide_to_long(spark: SparkSession, d: str) -> DataFrame:
    wide = sequences.long_to_wide(monthly(spark, d), ["o_orderpriority"], "m", "total", MONTHS)
    return sequences.wide_to_long(wide, ["o_orderpriority"], [str(m) for m in MONTHS])


@query("SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT NULL AS flag FROM events")
def generation_flag(spark: SparkSession, d: str) -> DataFrame:
    return sequences.generation_flag(table(spark, d, "events").withColumn("o", F.struct("ts", "event_id")), "user_id", "o").select("event_id", "flag")


@query("SELECT user_id, 200::INTEGER AS size, round(sum(value), 4) AS total FROM events GROUP BY 1")
def pad_sequences(spark: SparkSession, d: str) -> DataFrame:
    s = sequences.long_to_sequences(table(spark, d, "events"), "user_id", "ts", ["event_id", "value"])
    p = sequences.pad(s.select("user_id", F.transform("steps", lambda x: x["value"]).alias("v")), "v", 200)
    return p.select("user_id", F.size("v").alias("size"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("SELECT 'o_orderpriority' AS attribute, CAST(sum((n > 1)::INT) AS BIGINT) AS broken FROM (SELECT count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_custkey)")
def attribute_constancy(spark: SparkSession, d: str) -> DataFrame:
    return sequences.attribute_constancy(table(spark, d, "orders"), "o_custkey", ["o_orderpriority"])


@query("SELECT max(n) AS longest, min(n) AS shortest, count(*) AS examples, min(n) < 1000 AS variable FROM (SELECT count(*) AS n FROM events GROUP BY user_id)")
def sequence_lengths(spark: SparkSession, d: str) -> DataFrame:
    return sequences.check_lengths(table(spark, d, "events"), "user_id", 1000)


@query("SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS difference FROM events")
def discrete_difference(spark: SparkSession, d: str) -> DataFrame:
    return sequences.discrete_difference(table(spark, d, "events").withColumn("o", F.struct("ts", "event_id")), "user_id", "o", "value").select("event_id", r6("difference"))


@query("SELECT event_id, (['mon', 'tue', 'wed'])[((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 3) + 1] AS time FROM events")
def cycle_times(spark: SparkSession, d: str) -> DataFrame:
    e = sequences.positions(table(spark, d, "events").withColumn("o", F.struct("ts", "event_id")), "user_id", "o")
    return sequences.cycle_times(e, ["mon", "tue", "wed"]).select("event_id", "time")


# ---------------------------------------------------------------- sampling


def probability_sql(weight: str) -> str:
    each = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM orders GROUP BY 2" for c in ("o_orderstatus", "o_orderpriority"))
    return f"SELECT \"column\", value, n, {weight} / sum({weight}) OVER (PARTITION BY \"column\") AS p FROM ({each})"


@query(f"SELECT \"column\", value, n, round(p, 6) AS probability, round(sum(p) OVER (PARTITION BY \"column\" ORDER BY value), 6) AS high FROM ({probability_sql('n::DOUBLE')})")
def category_probabilities(spark: SparkSession, d: str) -> DataFrame:
    return sampling.category_probabilities(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"]).select("column", "value", "n", r6("probability"), r6("high"))


@query(f"SELECT \"column\", value, n, round(p, 6) AS probability, round(sum(p) OVER (PARTITION BY \"column\" ORDER BY value), 6) AS high FROM ({probability_sql('ln(n + 1.0)')})")
def log_category_probabilities(spark: SparkSession, d: str) -> DataFrame:
    return sampling.category_probabilities(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], log=True).select("column", "value", "n", r6("probability"), r6("high"))


@query(f"SELECT \"column\", value, round(p / 2, 6) AS probability, round(sum(p / 2) OVER (ORDER BY \"column\", value), 6) AS high FROM ({probability_sql('n::DOUBLE')})")
def uniform_column_probabilities(spark: SparkSession, d: str) -> DataFrame:
    return sampling.uniform_column_probabilities(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"]).select("column", "value", r6("probability"), r6("high"))


@query("SELECT o_orderpriority AS value, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey)::INTEGER AS rn FROM orders")
def rows_by_category(spark: SparkSession, d: str) -> DataFrame:
    return sampling.rows_by_category(table(spark, d, "orders"), "o_orderpriority", "o_orderkey")


def uniform(name: str):
    """A number in [0, 1) from the hash of a key, the same in SQL."""
    return F.conv(F.substr(F.md5(F.col(name).cast("string")), F.lit(1), F.lit(8)), 16, 10).cast("bigint") / F.lit(4294967296.0)


UNIFORM = "('0x' || substr(md5(c_custkey::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query(f"WITH p AS (SELECT value, sum(p) OVER (ORDER BY value) AS high, sum(p) OVER (ORDER BY value) - p AS low FROM ({probability_sql('n::DOUBLE')}) WHERE \"column\" = 'o_orderpriority'), u AS (SELECT c_custkey, {UNIFORM} AS r FROM customer), i AS (SELECT o_orderpriority AS value, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS cnt FROM orders) SELECT c_custkey, value, o_orderkey FROM u JOIN p ON r >= low AND r < high JOIN i USING (value) WHERE rn = floor(r * cnt) + 1")
def sample_with_given_uniforms(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    steps = sampling.category_probabilities(o, ["o_orderpriority"])
    drawn = sampling.draw(table(spark, d, "customer").select("c_custkey", uniform("c_custkey").alias("r")), "r", steps)
    return sampling.match_rows(drawn, "r", sampling.rows_by_category(o, "o_orderpriority", "o_orderkey")).select("c_custkey", "value", "o_orderkey")


# ---------------------------------------------------------------- text records

LINE = "concat(n_nationkey, ',', n_name, ',', n_regionkey)"


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", F.concat_ws(",", "n_nationkey", "n_name", "n_regionkey").alias("line"))


@query("SELECT token, (row_number() OVER (ORDER BY ascii(token)) - 1)::INTEGER AS id FROM (SELECT DISTINCT unnest(string_split(concat(n_name, chr(10)), '')) AS token FROM nation)")
def char_vocab(spark: SparkSession, d: str) -> DataFrame:
    return tokenizers.vocabulary(table(spark, d, "nation"), "n_name")


@query("WITH v AS (SELECT token, (row_number() OVER (ORDER BY ascii(token)) - 1) AS id FROM (SELECT DISTINCT unnest(string_split(concat(n_name, chr(10)), '')) AS token FROM nation)), c AS (SELECT n_nationkey, n_name, unnest(string_split(n_name, '')) AS token, unnest(range(1, length(n_name) + 1)) AS pos FROM nation) SELECT n_nationkey, string_agg(id::VARCHAR, ' ' ORDER BY pos) AS ids, any_value(n_name) AS back FROM c JOIN v USING (token) GROUP BY 1")
def char_encode(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    t = tokenizers.CharTokenizer.train(n, "n_name")
    ids = t.encode(F.col("n_name"))
    return n.select("n_nationkey", F.array_join(F.transform(ids, lambda i: i.cast("string")), " ").alias("ids"), t.decode(ids).alias("back"))


@query(f"SELECT n_nationkey, concat(replace({LINE}, ',', '<d>'), '<n>', chr(10)) AS tokens, {LINE} AS back FROM nation")
def annotate_delimiter(spark: SparkSession, d: str) -> DataFrame:
    t = X.to_tokens(F.col("line"), ",")
    return lines(spark, d).select("n_nationkey", t.alias("tokens"), X.from_tokens(t, ",").alias("back"))


@query("SELECT n_nationkey, concat('<col0>', n_nationkey, '<col1>', n_name, '<col2>', n_regionkey) AS marked FROM nation")
def column_markers(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("n_nationkey", X.mark_columns(F.col("line"), ",").alias("marked"))


@query(f"SELECT n_nationkey, {LINE} AS line FROM nation")
def strip_markers(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("n_nationkey", X.unmark_columns(X.mark_columns(F.col("line"), ","), ",").alias("line"))


@query("SELECT doc_id, len(string_split(regexp_replace(text, ',+$', ''), ','))::INTEGER AS n, string_split(regexp_replace(text, ',+$', ''), ',')[1] AS first FROM documents")
def split_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.split_record(F.col("text"), ",").alias("v")).select("doc_id", F.size("v").alias("n"), F.get("v", F.lit(0)).alias("first"))


@query("SELECT doc_id, len(string_split(text, ',')) = 5 AS valid FROM documents")
def field_count_valid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", records.field_count_check("text", ",", list("abcde")).alias("valid"))


@query("SELECT r_regionkey, concat(r_regionkey, '|', r_name, '|') AS prefix FROM region")
def seed_prefix(spark: SparkSession, d: str) -> DataFrame:
    return records.Seeds(("r_regionkey", "r_name"), "|").prefix(table(spark, d, "region"), ["r_regionkey", "r_name", "x"]).select("r_regionkey", "prefix")


@query("SELECT doc_id, replace(replace(replace(text, ',', '[c]'), chr(13), ''), chr(10), ' ') AS cell FROM documents")
def plain_cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.plain_cell(F.col("text")).alias("cell"))


JUDGED = "(SELECT *, sum((event_type = 'error')::INT) OVER w AS bad, sum((event_type <> 'error')::INT) OVER w AS good FROM events WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING))"


def judged(spark: SparkSession, d: str) -> DataFrame:
    return records.validate(table(spark, d, "events").withColumn("text", F.col("event_type")), "text", "text <> 'error'")


@query(f"SELECT event_id, bad::BIGINT AS n_invalid FROM {JUDGED} WHERE bad <= 50")
def invalid_budget(spark: SparkSession, d: str) -> DataFrame:
    return records.within_budget(judged(spark, d), "event_id", 50).select("event_id", "n_invalid")


@query(f"SELECT event_id FROM {JUDGED} WHERE event_type <> 'error' AND good <= 100")
def first_n_valid(spark: SparkSession, d: str) -> DataFrame:
    return records.accepted(records.within_budget(judged(spark, d), "event_id", 1 << 40, 100)).select("event_id")


@query("SELECT event_id FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 100")
def invalid_cache(spark: SparkSession, d: str) -> DataFrame:
    return records.invalid_cache(judged(spark, d), "event_id").select("event_id")


@query("SELECT CAST(sum((event_type <> 'error')::INT) AS BIGINT) AS valid_lines, CAST(sum((event_type = 'error')::INT) AS BIGINT) AS invalid_lines, 500::INTEGER AS max_invalid, sum((event_type <> 'error')::INT) >= 100 AS is_valid FROM events")
def generation_summary(spark: SparkSession, d: str) -> DataFrame:
    return records.summary(judged(spark, d), 100, 500)


@query("SELECT a.rank::INTEGER AS rank, a.c_name, a.c_mktsegment, b.c_acctbal FROM (SELECT row_number() OVER (ORDER BY c_custkey) AS rank, c_name, c_mktsegment FROM customer) a JOIN (SELECT row_number() OVER (ORDER BY c_custkey) AS rank, c_nationkey::VARCHAR AS c_acctbal FROM customer) b USING (rank)")
def assemble_records(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    one = records.validate(c.withColumn("text", F.concat_ws(",", "c_name", "c_mktsegment")), "text", "c_custkey is not null", ",")
    two = records.validate(c.withColumn("text", F.col("c_nationkey").cast("string")), "text", "c_custkey is not null", ",")
    return records.assemble([(one, ["c_name", "c_mktsegment"]), (two, ["c_acctbal"])], "c_custkey", ["c_name", "c_mktsegment", "c_acctbal"])


@query("SELECT n_nationkey::BIGINT AS key, n_name AS name, n_regionkey::BIGINT AS region FROM nation")
def typed_records(spark: SparkSession, d: str) -> DataFrame:
    return files.typed(lines(spark, d), "line", ["key", "name", "region"])


# ---------------------------------------------------------------- models (no SQL form)


@query(None)
def column_clusters(spark: SparkSession, d: str) -> DataFrame:
    groups = cluster.cluster_columns(table(spark, d, "customer"), "c_custkey", most=2)
    return spark.createDataFrame([(i, p, c) for i, g in enumerate(groups) for p, c in enumerate(g)], "cluster_id int, pos int, column string")


@query(None)
def gmm_normalize(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return codecs.MixtureCodec("o_totalprice", components=4).fit(t).encode(t)


@query(None)
def sample_copula(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    return synthesizers.CopulaSynthesizer(constraints=["c_acctbal > -900"], primary_key="c_custkey").fit(c).sample(spark, 500, seed=7)


@query(None)
def sample_sequences(spark: SparkSession, d: str) -> DataFrame:
    return synthesizers.SequenceSynthesizer("user_id", "ts", ["value"], ["event_type"]).fit(table(spark, d, "events")).sample(spark, 50, seed=7)


@query(None)
def generate_text(spark: SparkSession, d: str) -> DataFrame:
    return synthesizers.TextSynthesizer(3, "n_name").fit(table(spark, d, "nation")).sample(spark, 200, seed=7)


# ---------------------------------------------------------------- completion, whole records


@query("SELECT c_custkey, c_nationkey, c_mktsegment, true AS completed, true AS within FROM customer")
def complete_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's balance drawn anew given nation and segment: the known cells stay, the drawn ones lie in the fitted range."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    model = synthesizers.CopulaSynthesizer(primary_key="c_custkey").fit(c)
    low, high = model.range_of("c_acctbal")
    done = model.complete(c.drop("c_acctbal"), "c_custkey", seed=3)
    return done.select("c_custkey", "c_nationkey", "c_mktsegment", F.col("c_acctbal").isNotNull().alias("completed"), F.col("c_acctbal").between(low, high).alias("within"))


@query("SELECT 'BUILDING' AS c_mktsegment, 400::BIGINT AS n, 400::BIGINT AS over FROM (SELECT 1)")
def sample_with_conditions(spark: SparkSession, d: str) -> DataFrame:
    """400 customers of one segment under a constraint that few rows meet."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    model = synthesizers.CopulaSynthesizer(constraints=["c_acctbal > 9000"], primary_key="c_custkey").fit(c)
    drawn = model.sample(spark, 400, 5, {"c_mktsegment": "BUILDING"})
    return drawn.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 9000).alias("over"))


@query("SELECT o_orderkey, o_totalprice > 100000 AS valid, CASE WHEN o_totalprice > 100000 THEN NULL ELSE 'o_totalprice > 100000' END AS explain FROM orders")
def whole_record_check(spark: SparkSession, d: str) -> DataFrame:
    return records.validate_records(table(spark, d, "orders"), "o_totalprice > 100000").select("o_orderkey", "valid", "explain")
