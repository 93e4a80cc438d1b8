"""The same results in SQL, for the queries that SQL can express.

Table names are the views the checking engine registers over the given files.
"""

from __future__ import annotations

MESSY_COLUMNS = [
    "o_custkey", "status", "price", "price_text", "date_text", "priority_label", "flag_text", "age", "rating",
]
ALL = ", ".join(MESSY_COLUMNS)
NUMBERS = {
    "o_custkey": "CAST(o_custkey AS DOUBLE)",
    "price": "price",
    "price_text": "TRY_CAST(price_text AS DOUBLE)",
    "age": "CAST(age AS DOUBLE)",
    "rating": "rating",
}
TEXTS = ["status", "price_text", "date_text", "priority_label", "flag_text"]
LABELS = ["status", "priority_label", "flag_text"]
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

BASE = """base AS (
  SELECT o_orderkey AS row_id, o_custkey, o_orderstatus AS status,
    CASE WHEN o_orderkey % 997 = 5 THEN CAST(9999999 AS DOUBLE)
         WHEN o_orderkey % 1009 = 7 THEN CAST(-1000 AS DOUBLE)
         WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS price,
    CASE WHEN o_orderkey % 40 = 1 THEN 'TBD' WHEN o_orderkey % 40 = 2 THEN NULL
         ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS price_text,
    CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
         WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE strftime(o_orderdate, '%d-%b-%Y') END AS date_text,
    CASE o_orderkey % 5 WHEN 0 THEN upper(o_orderpriority) WHEN 1 THEN lower(o_orderpriority)
         WHEN 2 THEN concat(' ', o_orderpriority) ELSE o_orderpriority END AS priority_label,
    CASE o_orderkey % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'Y' WHEN 3 THEN 'N'
         WHEN 4 THEN 'TRUE' ELSE 'False' END AS flag_text,
    o_custkey % 100 AS age,
    CASE WHEN o_custkey % 100 > 75 THEN NULL ELSE CAST(o_orderkey % 97 AS DOUBLE) / 10 END AS rating
  FROM orders)"""
MESSY = f"""{BASE}, messy AS (
  SELECT row_id, {ALL} FROM base
  UNION ALL SELECT row_id + 1000000000, {ALL} FROM base WHERE row_id % 250 = 0
  UNION ALL SELECT row_id + 2000000000, o_custkey, 'Z', price, price_text, date_text, priority_label, flag_text, age,
    rating FROM base WHERE row_id % 333 = 0)"""
EVENTS_NULL = "events_null AS (SELECT event_id, CASE WHEN event_id % 7 < 2 THEN NULL ELSE value END AS value FROM events)"
GAPPY = """gappy AS (SELECT * REPLACE (CASE WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1996-08-31'
  THEN o_orderdate + INTERVAL 365 DAY ELSE o_orderdate END AS o_orderdate) FROM orders)"""
INFINITE = """infinite AS (SELECT o_orderkey AS row_id,
  CASE WHEN o_orderkey % 101 = 0 THEN CAST('inf' AS DOUBLE) WHEN o_orderkey % 103 = 0 THEN CAST('-inf' AS DOUBLE)
       ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey < 3 THEN o_totalprice WHEN o_orderkey % 100 = 50 THEN CAST('inf' AS DOUBLE) END AS few
  FROM orders)"""
CUSTOMER = """mess_c AS (SELECT c_custkey,
    CASE WHEN c_custkey % 100 < 77 THEN NULL ELSE c_name END AS c_name,
    CASE WHEN c_custkey % 5 = 2 THEN NULL ELSE c_nationkey END AS c_nationkey,
    CASE WHEN c_custkey % 400 = 9 THEN CAST(512330 AS DOUBLE) WHEN c_custkey % 50 = 1 THEN NULL ELSE c_acctbal END AS c_acctbal,
    CASE c_custkey % 5 WHEN 0 THEN upper(c_mktsegment) WHEN 1 THEN upper(c_mktsegment[1])
         WHEN 2 THEN concat(upper(c_mktsegment[1]), lower(c_mktsegment[2:])) ELSE lower(c_mktsegment) END AS c_mktsegment,
    CASE WHEN c_custkey % 36 = 0 THEN concat('$', CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR))
         ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) END AS balance_text
  FROM customer),
  customers AS (SELECT * FROM mess_c UNION ALL SELECT * FROM mess_c WHERE c_custkey % 45 = 0)"""
PARSED = """CASE WHEN date_text LIKE '____-__-__' THEN strptime(date_text, '%Y-%m-%d')
  WHEN date_text LIKE '__/__/____' THEN strptime(date_text, '%m/%d/%Y')
  WHEN date_text LIKE '__-___-____' THEN strptime(date_text, '%d-%b-%Y') END"""
DAY = "'%Y-%m-%d %H:%M:%S'"


def union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def messy(body: str, *ctes: str) -> str:
    return f"WITH {', '.join([MESSY, *ctes])} {body}"


def long_numbers(numbers: dict[str, str], source: str, extra: str = "row_id, ") -> str:
    return union([f"SELECT {i} AS position, '{c}' AS \"column\", {extra}{x} AS x FROM {source}" for i, (c, x) in enumerate(numbers.items())])


def long_texts(columns: list[str], source: str) -> str:
    return union([f"SELECT '{c}' AS \"column\", {c} AS v FROM {source}" for c in columns])


# -- shared pieces -------------------------------------------------------------

NUMERIC_ROW = """SELECT "column", round_even(avg(x), 4) AS mean, round_even(quantile_cont(x, 0.5), 4) AS median,
  round_even(stddev_samp(x), 4) AS std, round_even(min(x), 4) AS min, round_even(max(x), 4) AS max, round_even(skewness(x), 4) AS skewness,
  round_even(kurtosis(x), 4) AS kurtosis, count(*) FILTER (x = 0) AS zeros, count(DISTINCT x) AS unique_count,
  CAST(0 AS BIGINT) AS infinite_count FROM numbers GROUP BY "column\""""

FENCES = """fences AS (SELECT "column", quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, avg(x) AS m,
  stddev_samp(x) AS s FROM numbers GROUP BY "column")"""
FLAGS = """flags AS (SELECT n."column", row_id, x,
  q3 > q1 AND (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS iqr, abs((x - m) / s) > 3 AS zscore
  FROM numbers n JOIN fences f ON n."column" = f."column" WHERE x IS NOT NULL)"""
NUM = f"numbers AS ({long_numbers(NUMBERS, 'messy')})"

TYPES = f"""shares AS (
  SELECT "column", count(v) AS present, count(DISTINCT v) AS raw, count(DISTINCT lower(trim(v))) AS normal,
    bool_and(lower(trim(v)) IN ('true','false','yes','no','y','n')) AND count(DISTINCT lower(trim(v))) >= 2 AS is_boolean,
    avg(CASE WHEN TRY_CAST(v AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END) FILTER (v IS NOT NULL) AS numeric_share,
    avg(CASE WHEN v LIKE '____-__-__' OR v LIKE '__/__/____' OR v LIKE '__-___-____' THEN 1.0 ELSE 0.0 END)
      FILTER (v IS NOT NULL) AS datetime_share,
    bool_and(v LIKE '____-__-__') AS all_iso
  FROM ({long_texts(TEXTS, 'messy')}) GROUP BY "column"),
typed AS (SELECT "column", raw, present,
    CASE WHEN is_boolean THEN 'boolean' WHEN numeric_share = 1 THEN 'numeric' WHEN numeric_share >= 0.8 THEN 'mixed'
      WHEN numeric_share < 0.5 AND datetime_share >= 0.8 THEN 'datetime' WHEN raw <= 0.5 * present THEN 'categorical'
      ELSE 'text' END AS inferred_type, normal < raw AS inconsistent FROM shares)"""
STORAGE = {"o_custkey": "bigint", "price": "double", "age": "bigint", "rating": "double"}
COLUMN_TABLE = f"""{TYPES}, {NUM}, {FENCES}, {FLAGS},
counted AS (SELECT "column", count(*) FILTER (iqr) AS iqr_count, count(*) FILTER (zscore) AS zscore_count FROM flags GROUP BY "column"),
nulls AS ({union([f"SELECT {i} AS position, '{c}' AS \"column\", '{STORAGE.get(c, 'string')}' AS storage_type, count(*) AS n, count(*) FILTER ({c} IS NULL) AS missing_count FROM messy" for i, c in enumerate(MESSY_COLUMNS)])}),
cols AS (SELECT position, nulls."column", storage_type, coalesce(inferred_type, 'numeric') AS inferred_type,
    CASE WHEN storage_type <> 'string' THEN false WHEN inferred_type = 'categorical' THEN inconsistent
         ELSE inferred_type <> 'text' END AS type_mismatch,
    n, missing_count, round(100.0 * missing_count / n, 2) AS missing_pct,
    coalesce(iqr_count, 0) AS iqr_count, round(100.0 * coalesce(iqr_count, 0) / n, 2) AS iqr_pct,
    coalesce(zscore_count, 0) AS zscore_count, round(100.0 * coalesce(zscore_count, 0) / n, 2) AS zscore_pct,
    coalesce(inferred_type IN ('categorical', 'boolean') AND raw > 0.5 * present, false) OR coalesce(inferred_type = 'text', false) AS high_cardinality
  FROM nulls LEFT JOIN typed ON nulls."column" = typed."column" LEFT JOIN counted ON nulls."column" = counted."column"),
groups AS (SELECT {ALL}, count(*) AS copies FROM messy GROUP BY {ALL}),
exact AS (SELECT CAST(coalesce(sum(copies - 1), 0) AS BIGINT) AS exact_count, CAST(coalesce(sum(copies) FILTER (copies > 1), 0) AS BIGINT) AS rows_in_groups,
    CAST(sum(copies) AS BIGINT) AS n, round(100.0 * coalesce(sum(copies - 1), 0) / sum(copies), 2) AS exact_pct FROM groups),
quality AS (SELECT *, CASE WHEN quality_score >= 90 THEN 'A' WHEN quality_score >= 80 THEN 'B' WHEN quality_score >= 70 THEN 'C'
      WHEN quality_score >= 60 THEN 'D' ELSE 'F' END AS quality_grade FROM (
  SELECT max(n) AS rows, count(*) AS columns, CAST(sum(missing_count) AS BIGINT) AS total_missing_cells,
    round(100.0 * sum(missing_count) / sum(n), 2) AS overall_missing_pct,
    CAST(greatest(0, least(100, round_even(100 - least(40, 2 * round(100.0 * sum(missing_count) / sum(n), 2))
      - 20.0 * count(*) FILTER (type_mismatch) / count(*) - least(10, (SELECT exact_pct FROM exact))
      - least(10, 2 * coalesce(avg(iqr_pct) FILTER (iqr_pct > 0), 0))
      + 5.0 * count(*) FILTER (NOT type_mismatch AND missing_count = 0) / count(*), 0))) AS INTEGER) AS quality_score
  FROM cols)),
warned AS (
  SELECT position, "column", 1 AS rule, concat('Over 50% of values are missing (', format('{{:.1f}}', missing_pct), '%)') AS warning FROM cols WHERE missing_pct > 50
  UNION ALL SELECT position, "column", 2, concat('Type mismatch: values appear to be ', inferred_type, ' but are stored as ', storage_type, ' — ',
    CASE WHEN inferred_type IN ('numeric', 'datetime', 'boolean') THEN concat('fix_types(..., ''', inferred_type, ''') converts it')
      WHEN inferred_type = 'mixed' THEN 'some cells are no numbers; look at them before converting' ELSE 'fix_types can convert it' END) FROM cols WHERE type_mismatch
  UNION ALL SELECT position, "column", 3, 'High cardinality: column may be an ID or free text rather than a true categorical' FROM cols WHERE high_cardinality
  UNION ALL SELECT position, "column", 4, concat(format('{{:,}}', iqr_count), ' outliers detected (', format('{{:.1f}}', iqr_pct), '%, IQR method)') FROM cols WHERE iqr_pct > 5),
advised AS (
  SELECT 0 AS seq, CASE WHEN exact_pct > 5 THEN 'critical' ELSE 'warning' END AS severity, 'duplicate' AS category, CAST(NULL AS VARCHAR) AS "column",
    concat(format('{{:,}}', exact_count), ' exact duplicate rows detected (', format('{{:.1f}}', exact_pct), '%) — consider deduplication before analysis or modeling') AS message
  FROM exact WHERE exact_count > 0
  UNION ALL SELECT 100 + position * 3, CASE WHEN missing_pct >= 50 THEN 'critical' ELSE 'warning' END, 'missing', "column",
    concat(format('{{:.1f}}', missing_pct), '% of values are missing — consider ', CASE WHEN missing_pct >= 50 THEN 'dropping this column' ELSE 'imputation or dropping' END)
  FROM cols WHERE missing_pct >= 30
  UNION ALL SELECT 101 + position * 3, 'warning', 'type', "column",
    concat('Stored as ', storage_type, ' but inferred as ', inferred_type, ' — consider type conversion') FROM cols WHERE type_mismatch
  UNION ALL SELECT 102 + position * 3, CASE WHEN iqr_pct > 10 THEN 'critical' WHEN iqr_pct > 3 THEN 'warning' ELSE 'info' END, 'outlier', "column",
    concat(format('{{:,}}', iqr_count), ' outliers detected (', format('{{:.1f}}', iqr_pct), '%, IQR method) — review before modeling or impute/remove') FROM cols WHERE iqr_count > 0),
ranked AS (SELECT *, CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END * 100000 + seq AS place FROM advised)"""

NEAR = "near AS (SELECT row_id FROM (SELECT row_id, {windows}, count(*) OVER (PARTITION BY {all}) AS copies FROM messy) WHERE copies = 1 AND ({any}))".format(
    windows=", ".join(
        f"count(*) OVER (PARTITION BY {', '.join(c for c in MESSY_COLUMNS if c != odd)}) AS w{i}" for i, odd in enumerate(MESSY_COLUMNS)
    ),
    all=ALL,
    any=" OR ".join(f"w{i} > 1" for i in range(len(MESSY_COLUMNS))),
)
COPIES = f"copied AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY {ALL}) AS copies FROM messy) WHERE copies > 1)"

TARGETS = ["price", "price_text", "rating"]
BISERIAL = "biserial AS ({})".format(
    union(
        [
            f"""SELECT '{t}' AS target, '{c}' AS "column", count(x) AS n, count(x) FILTER (gap = 1) AS k,
                CASE WHEN count(x) FILTER (gap = 1) >= 10 AND count(x) FILTER (gap = 0) >= 10 THEN corr(x, gap) END AS value
                FROM (SELECT {x} AS x, CASE WHEN {t} IS NULL THEN 1.0 ELSE 0.0 END AS gap FROM messy) WHERE x IS NOT NULL"""
            for t in TARGETS
            for c, x in NUMBERS.items()
            if c != t
        ]
    )
)
GAP_V = "gap_v AS ({})".format(
    union(
        [
            f"""SELECT '{t}' AS target, '{c}' AS "column", n, levels, chi2,
              CASE WHEN least(1 - 1 / (n - 1.0), levels - 1 - (levels - 1) ** 2 / (n - 1.0)) > 0 THEN
                sqrt(greatest(0, chi2 / n - (levels - 1) / (n - 1.0)) / least(1 - 1 / (n - 1.0), levels - 1 - (levels - 1) ** 2 / (n - 1.0))) ELSE 0.0 END AS value
            FROM (SELECT CAST(sum(t) AS BIGINT) AS n, CAST(sum(m) AS BIGINT) AS k, count(*) AS levels,
                sum(t) * (sum(m * m / t) / sum(m) + sum((t - m) * (t - m) / t) / (sum(t) - sum(m)) - 1) AS chi2
              FROM (SELECT {c} AS v, CAST(count(*) AS DOUBLE) AS t, CAST(count(*) FILTER ({t} IS NULL) AS DOUBLE) AS m FROM messy
                    WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) >= 5))
            WHERE levels >= 2 AND k >= 10 AND n - k >= 10"""
            for t in TARGETS
            for c in LABELS
        ]
    )
)
PHI = "phi AS ({})".format(
    union(
        [
            f"""SELECT '{a}' AS target, '{b}' AS "column", count(*) AS n,
              corr(CASE WHEN {a} IS NULL THEN 1.0 ELSE 0.0 END, CASE WHEN {b} IS NULL THEN 1.0 ELSE 0.0 END) AS value FROM messy"""
            for a in TARGETS
            for b in TARGETS
            if a != b
        ]
    )
)
# The densities of t and of the root of chi-squared, integrated from 0 by Simpson's rule in 4,000 steps; beyond 40 nothing is left.
TAILS = """pairs AS (SELECT target, "column", 'point_biserial' AS method, n - 2.0 AS free, abs(value) * sqrt((n - 2) / (1 - value * value)) AS top
    FROM biserial WHERE value IS NOT NULL
  UNION ALL SELECT target, "column", 'missing_together', n - 2.0, abs(value) * sqrt((n - 2) / (1 - value * value)) FROM phi
  UNION ALL SELECT target, "column", 'cramers_v', levels - 1.0, sqrt(greatest(chi2, 0)) FROM gap_v),
steps AS (SELECT *, least(top, 40) / 4000 AS h, least(top, 40) / 4000 * i AS u,
    CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS weight FROM pairs, (SELECT unnest(range(4001)) AS i)),
tails AS (SELECT target, "column", method, greatest(0, 1 - sum(h / 3 * weight * CASE
    WHEN method = 'cramers_v' THEN 2 * exp(-u * u / 2) * CASE WHEN free = 1 THEN 1 ELSE pow(u, free - 1) END / exp(free / 2 * ln(2) + lgamma(free / 2))
    ELSE 2 * exp(lgamma((free + 1) / 2) - lgamma(free / 2) - ln(free * pi()) / 2 - (free + 1) / 2 * ln(1 + u * u / free)) END)) AS p_value
  FROM steps GROUP BY target, "column", method)"""
# every pair this strong has a p-value far below the limit on these row counts
RELATED = """related AS (SELECT target, CAST(row_number() OVER (PARTITION BY target ORDER BY abs(value) DESC, "column") AS INTEGER) AS rank, "column", method, round(value, 3) AS value
  FROM (SELECT target, "column", 'point_biserial' AS method, value FROM biserial UNION ALL SELECT target, "column", 'cramers_v', value FROM gap_v
        UNION ALL SELECT target, "column", 'missing_together', value FROM phi)
  WHERE abs(value) >= 0.3 AND (method = 'point_biserial' OR value > 0) QUALIFY rank <= 5)"""


def pearson_rows(numbers: dict[str, str], source: str) -> str:
    names = list(numbers)
    parts = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            parts.append(
                f"SELECT '{a}' AS col_a, '{b}' AS col_b, count(*) AS n, CASE WHEN count(*) >= 10 THEN corr({numbers[a]}, {numbers[b]}) END AS value "
                f"FROM {source} WHERE {numbers[a]} IS NOT NULL AND {numbers[b]} IS NOT NULL"
            )
    return union(parts)


def cramers_rows(columns: list[str], source: str) -> str:
    parts = []
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            parts.append(
                f"""SELECT '{a}' AS col_a, '{b}' AS col_b, n, chi2, rows_a, rows_b, CASE WHEN rows_a < 2 OR rows_b < 2 THEN 0.0
                WHEN least(rows_a - 1 - (rows_a - 1) ** 2 / (n - 1.0), rows_b - 1 - (rows_b - 1) ** 2 / (n - 1.0)) <= 0 THEN 0.0
                ELSE sqrt(greatest(0, chi2 / n - (rows_a - 1) * (rows_b - 1) / (n - 1.0))
                  / least(rows_a - 1 - (rows_a - 1) ** 2 / (n - 1.0), rows_b - 1 - (rows_b - 1) ** 2 / (n - 1.0))) END AS value
                FROM (SELECT CAST(sum(c) AS BIGINT) AS n, count(DISTINCT a) AS rows_a, count(DISTINCT b) AS rows_b, sum(c) * (sum(CAST(c AS DOUBLE) * c / ra / cb) - 1) AS chi2
                  FROM (SELECT a, b, c, sum(c) OVER (PARTITION BY a) AS ra, sum(c) OVER (PARTITION BY b) AS cb
                    FROM (SELECT {a} AS a, {b} AS b, count(*) AS c FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL)))"""
            )
    return union(parts)


MIRRORED = """both_ways AS (SELECT col_a, col_b, value FROM pairs UNION ALL SELECT col_b, col_a, value FROM pairs
  UNION ALL SELECT DISTINCT c, c, 1.0 FROM (SELECT col_a AS c FROM pairs UNION SELECT col_b FROM pairs))"""
LINE_PAIRS = f"pairs AS ({pearson_rows({c: c for c in LINE_NUMBERS}, 'lineitem')})"
HIGH_LINES = "wide AS (SELECT *, l_extendedprice * 2 AS gross, lower(l_returnflag) AS flag, lower(l_returnflag) AS ship_mode FROM lineitem)"


def bins(values: str, count: str) -> str:
    return f"""WITH v AS ({values}), edge AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS n, {count} AS bins FROM v),
      w AS (SELECT *, (hi - lo) / bins AS width FROM edge)
      SELECT CAST(bin AS INTEGER) AS bin, round(lo + bin * width, 4) AS bin_start, round(lo + (bin + 1) * width, 4) AS bin_end, c AS count,
        round(c / (n * width), 12) AS density FROM (SELECT least(CAST(floor((x - lo) / width) AS BIGINT), bins - 1) AS bin, count(*) AS c FROM v, w GROUP BY 1), w"""


def gaps_of(column: str, source: str) -> str:
    return f"""SELECT '{column}' AS "column", max(d) AS max_gap_days, count(*) FILTER (d > greatest(1, 3 * m)) AS gap_count, round(max(m), 1) AS median_gap_days
      FROM (SELECT d, median(d) OVER () AS m FROM (SELECT CAST(floor((epoch_us({column}) - epoch_us(lag({column}) OVER (ORDER BY {column}))) / 86400000000.0) AS BIGINT) AS d FROM {source}) WHERE d IS NOT NULL)"""


def fill(direction: str) -> str:
    frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW" if direction == "last" else "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    return f"WITH {EVENTS_NULL} SELECT event_id, {direction}_value(value IGNORE NULLS) OVER (ORDER BY event_id {frame}) AS value FROM events_null"


def dedup(pick: str, having: str = "") -> str:
    return messy(f"SELECT {pick}(row_id) AS row_id, {ALL} FROM messy GROUP BY {ALL} {having}")


def shape(expression: str, name: str) -> str:
    return union([f"SELECT '{c}' AS \"column\", {expression.format(c=c)} AS {name} FROM events" for c in ("value", "user_id")])


SKEW_LABEL = """CASE WHEN abs(skewness({c})) < 0.5 THEN 'symmetric' WHEN skewness({c}) >= 1 THEN 'highly right-skewed'
  WHEN skewness({c}) > 0 THEN 'moderately right-skewed' WHEN skewness({c}) <= -1 THEN 'highly left-skewed' ELSE 'moderately left-skewed' END"""
KURT_LABEL = "CASE WHEN kurtosis({c}) > 1 THEN 'leptokurtic' WHEN kurtosis({c}) < -1 THEN 'platykurtic' ELSE 'mesokurtic' END"

# population moments, then the two published transforms to a normal score
def omnibus(numbers: str) -> str:
    return f"""WITH numbers AS ({numbers}),
 centre AS (SELECT "column" AS c, avg(x) AS m FROM numbers GROUP BY 1),
 mom AS (SELECT "column", CAST(count(*) AS DOUBLE) AS n, avg((x-m)**2) AS m2, avg((x-m)**3) AS m3, avg((x-m)**4) AS m4 FROM numbers JOIN centre ON c = "column" GROUP BY 1),
 g AS (SELECT "column", n, m3 / m2 ** 1.5 AS g1, m4 / m2 ** 2 - 3 AS g2 FROM mom),
 a AS (SELECT *, g1 * sqrt((n+1)*(n+3)/(6*(n-2))) AS y, 3*(n*n+27*n-70)*(n+1)*(n+3)/((n-2)*(n+5)*(n+7)*(n+9)) AS beta,
   3*(n-1)/(n+1) AS e, 24*n*(n-2)*(n-3)/((n+1)**2*(n+3)*(n+5)) AS v, 6*(n*n-5*n+2)/((n+7)*(n+9))*sqrt(6*(n+3)*(n+5)/(n*(n-2)*(n-3))) AS s FROM g),
 b AS (SELECT *, sqrt(2*(beta-1))-1 AS w2, 6+8/s*(2/s+sqrt(1+4/(s*s))) AS aa FROM a),
 d AS (SELECT *, asinh(y/sqrt(2/(w2-1)))/sqrt(0.5*ln(w2)) AS z1, 1+(g2+3-e)/sqrt(v)*sqrt(2/(aa-4)) AS d FROM b),
 z AS (SELECT *, ((1-2/(9*aa)) - sign(d)*((1-2/aa)/abs(d))**(1/3.0))/sqrt(2/(9*aa)) AS z2 FROM d)
 SELECT "column", CAST(n AS BIGINT) AS n, 'k2' AS test, round(exp(-(z1*z1+z2*z2)/2), 6) AS p_value, exp(-(z1*z1+z2*z2)/2) >= 0.05 AS is_normal FROM z"""

WIDE_NUMBERS = "wide_numbers AS (SELECT {} FROM orders)".format(
    ", ".join(
        f"CASE WHEN o_orderkey % {i + 7} <> 0 THEN o_totalprice * {int(i % 3 == 0)} + (o_orderkey * {i + 3} % {97 + i}) * 1000.0 END AS n{i}"
        for i in range(30)
    )
)
WIDE_LABELS = "wide_labels AS (SELECT {} FROM orders)".format(
    ", ".join(f"CAST((o_orderkey // {i + 1} + o_custkey % 2) % {2 + i % 5} AS VARCHAR) AS g{i}" for i in range(20))
)
_WIDE = [f"w{i}" for i in range(60)]
# rows one column apart: the column is left out in turn, and the rest made one text
NEAR_WIDE = f"""WITH base AS (SELECT o_orderkey AS row_id, {", ".join(f"(o_orderkey * {i + 1} + o_custkey) % {50 + i} AS w{i}" for i in range(60))} FROM orders),
 every AS (SELECT * FROM base
  UNION ALL SELECT row_id + 1000000000, {", ".join(f"CASE WHEN row_id // 40 % 60 = {i} THEN -1 ELSE w{i} END" for i in range(60))} FROM base WHERE row_id % 40 = 0
  UNION ALL SELECT row_id + 2000000000, {", ".join(_WIDE)} FROM base WHERE row_id % 60 = 0),
 listed AS (SELECT row_id, [{", ".join(_WIDE)}] AS w FROM every),
 keyed AS (SELECT row_id, w, i, hash(list_concat(w[1:i - 1], [0], w[i + 1:])) AS k FROM (SELECT row_id, w, unnest(range(1, 61)) AS i FROM listed)),
 copied AS (SELECT row_id, count(*) OVER (PARTITION BY w) AS copies FROM listed)
 SELECT DISTINCT k.row_id FROM (SELECT row_id, count(*) OVER (PARTITION BY i, k) AS n FROM keyed) k JOIN copied c ON c.row_id = k.row_id
 WHERE k.n > 1 AND c.copies = 1"""
_GAPS = [f"t{i}" for i in range(60)]
PATTERNS_WIDE = f"""WITH wide AS (SELECT o_orderkey AS row_id, o_totalprice AS price, {", ".join(
    f"CASE WHEN NOT ({'o_totalprice > 300000' if i % 10 == 9 else f'o_orderkey % {i + 11} = 0'}) THEN CAST((o_orderkey * 7 + {i}) % 50 AS DOUBLE) END AS t{i}"
    for i in range(60)
)} FROM orders),
 cells AS (FROM (SELECT row_id, price, {", ".join(_GAPS)} FROM wide) UNPIVOT INCLUDE NULLS (x FOR c IN (price, {", ".join(_GAPS)}))),
 gaps AS (SELECT row_id, c AS target, CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END AS gap FROM cells WHERE c <> 'price'),
 counts AS (SELECT c, count(*) AS n, count(*) FILTER (x IS NULL) AS missing FROM cells GROUP BY c),
 tests AS (
  SELECT g.target, corr(v.x, g.gap) AS r FROM gaps g JOIN cells v ON g.row_id = v.row_id AND v.c <> g.target WHERE v.x IS NOT NULL
  GROUP BY g.target, v.c HAVING sum(g.gap) >= 10 AND sum(1 - g.gap) >= 10
  UNION ALL SELECT a.target, CASE WHEN corr(a.gap, b.gap) > 0 THEN corr(a.gap, b.gap) END FROM gaps a JOIN gaps b ON a.row_id = b.row_id AND a.target <> b.target
  GROUP BY a.target, b.target HAVING sum(a.gap) >= 10 AND sum(b.gap) >= 10 AND sum(1 - a.gap) >= 10 AND sum(1 - b.gap) >= 10)
 SELECT c AS "column", missing AS missing_count, CASE WHEN missing = 0 THEN 'none' WHEN c NOT IN (SELECT target FROM tests) THEN 'unknown'
   WHEN c IN (SELECT target FROM tests WHERE abs(r) >= 0.3) THEN 'MAR' ELSE 'MCAR' END AS missing_pattern FROM counts"""

MEDIAN_PRICE = "(SELECT quantile_cont(price, 0.5) FROM {source})"
IQR_PRICE = "edges AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM messy), outl AS (SELECT row_id FROM messy, edges WHERE price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1))"
DATA_BUT = ", ".join(c for c in MESSY_COLUMNS if c not in ("price", "priority_label"))

# fills and fixes first, then the outlier rows, then dropped rows, then copies
TIERED = f"""{MESSY}, {IQR_PRICE}, filled AS (SELECT row_id, {DATA_BUT}, coalesce(price, {MEDIAN_PRICE.format(source='messy')}) AS price, lower(trim(priority_label)) AS priority_label FROM messy),
 kept AS (SELECT * FROM filled WHERE row_id NOT IN (SELECT row_id FROM outl)), dense AS (SELECT * FROM kept WHERE rating IS NOT NULL),
 cleaned AS (SELECT min(row_id) AS row_id, {ALL} FROM dense GROUP BY {ALL})"""
GIVEN = f"""{MESSY}, {IQR_PRICE}, dense AS (SELECT * FROM messy WHERE rating IS NOT NULL),
 single AS (SELECT min(row_id) AS row_id, {ALL} FROM dense GROUP BY {ALL}),
 filled AS (SELECT row_id, {DATA_BUT}, coalesce(price, {MEDIAN_PRICE.format(source='single')}) AS price, lower(trim(priority_label)) AS priority_label FROM single),
 cleaned AS (SELECT * FROM filled WHERE row_id NOT IN (SELECT row_id FROM outl))"""

# the suggested plan: price filled with the median, gaps in price_text with 0.00, types fixed, price capped,
# rows without rating dropped, copies removed
SUGGESTED = f"""{MESSY}, filled AS (SELECT row_id, o_custkey, status, coalesce(price, {MEDIAN_PRICE.format(source='messy')}) AS price, coalesce(price_text, '0.00') AS price_text,
   date_text, lower(trim(priority_label)) AS priority_label, lower(trim(flag_text)) IN ('true', 'yes', 'y', '1') AS flag_text, age, rating FROM messy),
 edge AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM filled),
 capped AS (SELECT filled.* REPLACE (least(greatest(price, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) AS price) FROM filled, edge),
 cleaned AS (SELECT min(row_id) AS row_id, {ALL} FROM capped WHERE rating IS NOT NULL GROUP BY {ALL})"""


def oracle_sql() -> dict[str, str]:
    return {
        "scan_csv": messy(f"SELECT row_id, {ALL} FROM messy"),
        "sniff_separator": messy("SELECT ';' AS separator, 10 AS columns, count(*) AS rows FROM messy"),
        "sniff_encoding": "SELECT 'UTF-8' AS written, 'UTF-8' AS encoding UNION ALL SELECT 'ISO-8859-1', CASE WHEN count(*) FILTER (regexp_matches(text, '[à-ÿ]')) > 0 THEN 'windows-1252' ELSE 'UTF-8' END FROM documents",
        "null_tokens": "SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 11 IN (0, 1, 2, 3, 5, 6) THEN NULL WHEN o_orderkey % 11 = 4 THEN 'none' ELSE o_orderpriority END AS text FROM orders",
        "bad_lines": "SELECT count(*) FILTER (o_orderkey % 50 <> 1) AS kept, count(*) FILTER (o_orderkey % 50 = 2) AS padded, count(*) FILTER (o_orderkey % 50 = 1) AS dropped FROM orders",
        "input_guards": messy("SELECT count(*) AS rows, 10 AS columns, count(*) = 0 AS is_empty, true AS has_columns, count(*) > 100000 AS is_large FROM messy"),
        "preview": messy(f"SELECT row_id, {ALL} FROM messy ORDER BY row_id LIMIT 10"),
        "write_csv": f"SELECT * REPLACE (strftime(ts, {DAY}) AS ts) FROM events",
        "csv_text_roundtrip": "SELECT doc_id, sha256(text) AS text_sha256 FROM documents",
        "csv_single_file": "SELECT doc_id, sha256(text) AS text_sha256 FROM documents",
        "write_parquet": f"SELECT * REPLACE (CASE WHEN event_id % 7 < 2 THEN NULL ELSE value END AS value, strftime(ts, {DAY}) AS ts) FROM events",
        "row_numbers": "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS _row_id, c_custkey FROM customer",
        "load_named": "SELECT c_mktsegment, count(*) AS rows FROM customer GROUP BY 1",
        "inject_mess": messy(f"SELECT row_id, {ALL} FROM messy"),
        "inject_mess_labels": f"WITH {CUSTOMER} SELECT * FROM customers",
        "inject_clean": "SELECT * FROM supplier",
        "detect_types": messy('SELECT "column", storage_type, inferred_type, type_mismatch FROM cols', COLUMN_TABLE),
        "bool_like": messy('SELECT "column", is_boolean FROM shares', TYPES),
        "numeric_ratio": messy('SELECT "column", present, round(numeric_share, 6) AS numeric_share FROM shares', TYPES),
        "datetime_ratio": messy('SELECT "column", round(datetime_share, 6) AS datetime_share FROM shares', TYPES),
        "all_iso": messy('SELECT "column", all_iso FROM shares', TYPES),
        "parse_dates": messy(f"SELECT row_id, date_text, strftime({PARSED}, {DAY}) AS parsed FROM messy"),
        "cardinality_ratio": messy('SELECT "column", present, round(raw / present, 6) AS cardinality_ratio FROM shares', TYPES),
        "case_inconsistent": messy('SELECT "column", raw AS distinct_raw, normal AS distinct_normal, normal < raw AS case_inconsistent FROM shares', TYPES),
        "numeric_coerce": messy("SELECT row_id, TRY_CAST(price_text AS DOUBLE) AS price_text FROM messy"),
        "infinite_count": f"WITH {INFINITE} "
        + union([f"SELECT '{c}' AS \"column\", count({c}) AS number_count, count(*) FILTER (isfinite({c})) AS finite_count, count(*) FILTER (isinf({c})) AS infinite_count FROM infinite" for c in ("price", "few")]),
        "numeric_stats": f"WITH numbers AS ({long_numbers({c: c for c in LINE_NUMBERS}, 'lineitem', '')}) {NUMERIC_ROW}",
        "numeric_stats_messy": messy(NUMERIC_ROW, NUM),
        "skewness": shape("round(skewness({c}), 4)", "skewness"),
        "kurtosis": shape("round(kurtosis({c}), 4)", "kurtosis"),
        "skew_label": shape(SKEW_LABEL, "skew_label"),
        "kurtosis_label": shape(KURT_LABEL, "kurtosis_label"),
        "categorical_stats": messy(f'SELECT "column", count(DISTINCT v) AS unique_count, round(count(DISTINCT v) / count(v), 4) AS cardinality_ratio FROM ({long_texts(LABELS, "messy")}) GROUP BY 1'),
        "top_values": messy(f'SELECT "column", CAST(row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS INTEGER) AS rank, value, count FROM (SELECT "column", v AS value, count(*) AS count FROM ({long_texts(LABELS, "messy")}) GROUP BY 1, 2) QUALIFY rank <= 5'),
        "datetime_stats": messy(f"SELECT 'date_text' AS \"column\", strftime(min(d), {DAY}) AS min_date, strftime(max(d), {DAY}) AS max_date, CAST(floor((epoch_us(max(d)) - epoch_us(min(d))) / 86400000000.0) AS BIGINT) AS range_days FROM (SELECT {PARSED} AS d FROM messy)"),
        "datetime_stats_events": f"SELECT 'ts' AS \"column\", strftime(min(ts), {DAY}) AS min_date, strftime(max(ts), {DAY}) AS max_date, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0) AS BIGINT) AS range_days FROM events",
        "text_stats": union([f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS unique_count, round(avg(length({c})), 2) AS avg_length, CAST(max(length({c})) AS INTEGER) AS max_length, CAST(min(length({c})) AS INTEGER) AS min_length FROM documents" for c in ("text", "source")]),
        "normaltest": omnibus(long_numbers({c: c for c in LINE_NUMBERS}, "lineitem", "")),
        "normality_small": omnibus(union([f"SELECT '{c}' AS \"column\", {c} AS x FROM {t}" for t, c in (("supplier", "s_acctbal"), ("customer", "c_acctbal"), ("part", "p_retailprice"), ("part", "p_size"))])),
        "datetime_gaps": f"WITH {GAPPY} {gaps_of('o_orderdate', 'gappy')}",
        "datetime_gaps_sparse": f"WITH {GAPPY}, firsts AS (SELECT o_custkey, min(o_orderdate) AS first_order FROM gappy GROUP BY 1) {gaps_of('first_order', 'firsts')}",
        "high_cardinality": union([f"SELECT '{c}' AS \"column\", round(count(DISTINCT {c}) / count({c}), 4) AS cardinality_ratio, count(DISTINCT {c}) / count({c}) > 0.5 AS high_cardinality FROM {t}" for t, c in (("lineitem", "l_returnflag"), ("lineitem", "l_linestatus"), ("customer", "c_name"))]),
        "missing_overall": messy("SELECT total_missing_cells, overall_missing_pct FROM quality", COLUMN_TABLE),
        "missing_per_column": messy('SELECT "column", missing_count, missing_pct FROM cols', COLUMN_TABLE),
        "missing_cooccurrence": messy("SELECT * FROM (" + union([f"SELECT '{a}' AS column_a, '{b}' AS column_b, count(*) FILTER ({a} IS NULL AND {b} IS NULL) AS rows FROM messy" for i, a in enumerate(MESSY_COLUMNS) for b in MESSY_COLUMNS[i + 1 :]]) + ") WHERE rows > 0"),
        "point_biserial": messy('SELECT target, "column", n, round(value, 4) AS value FROM biserial WHERE value IS NOT NULL', BISERIAL),
        "missing_cramers": messy('SELECT target, "column", n, levels, round(chi2, 4) AS chi2, round(value, 4) AS value FROM gap_v', GAP_V),
        "missing_phi": messy('SELECT target, "column", n, round(value, 4) AS value FROM phi', PHI),
        "missing_tests": messy(
            """SELECT target, "column", method, round(value, 4) AS value, count(*) OVER (PARTITION BY target) AS tests FROM (
              SELECT target, "column", 'point_biserial' AS method, value FROM biserial WHERE value IS NOT NULL
              UNION ALL SELECT target, "column", 'cramers_v', value FROM gap_v UNION ALL SELECT target, "column", 'missing_together', value FROM phi)""",
            BISERIAL, GAP_V, PHI,
        ),
        "missing_p_values": messy(
            'SELECT target, "column", method, round(p_value, 6) AS p_value, count(*) OVER (PARTITION BY target) AS tests FROM tails',
            BISERIAL, GAP_V, PHI, TAILS,
        ),
        "missing_related": messy("SELECT * FROM related", BISERIAL, GAP_V, PHI, RELATED),
        "missing_pattern": messy(
            'SELECT "column", missing_count, CASE WHEN missing_count = 0 THEN \'none\' WHEN "column" IN (SELECT target FROM related) THEN \'MAR\' ELSE \'MCAR\' END AS missing_pattern FROM cols',
            COLUMN_TABLE, BISERIAL, GAP_V, PHI, RELATED,
        ),
        "patterns_wide": PATTERNS_WIDE,
        "iqr_fences": messy('SELECT "column", round(q1, 4) AS q1, round(q3, 4) AS q3, round(q1 - 1.5 * (q3 - q1), 4) AS lower, round(q3 + 1.5 * (q3 - q1), 4) AS upper FROM fences', NUM, FENCES),
        "iqr_outliers": messy('SELECT "column", row_id, x AS value FROM flags WHERE iqr', NUM, FENCES, FLAGS),
        "zscore_outliers": messy('SELECT "column", row_id, x AS value FROM flags WHERE zscore', NUM, FENCES, FLAGS),
        "outliers_small": f"WITH {INFINITE} SELECT 'few' AS \"column\", m AS method, row_id FROM infinite, (VALUES ('iqr'), ('zscore')) AS t(m) WHERE isinf(few)",
        "outlier_rows": messy("SELECT \"column\", 'iqr' AS method, row_id, x AS value FROM flags WHERE iqr UNION ALL SELECT \"column\", 'zscore', row_id, x FROM flags WHERE zscore", NUM, FENCES, FLAGS),
        "outlier_rows_infinite": f"""WITH {INFINITE}, fin AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3, avg(price) AS m, stddev_samp(price) AS s FROM infinite WHERE isfinite(price))
          SELECT 'price' AS "column", 'iqr' AS method, row_id FROM infinite, fin WHERE price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1)
          UNION ALL SELECT 'price', 'zscore', row_id FROM infinite, fin WHERE isinf(price) OR abs((price - m) / s) > 3""",
        "outlier_summary": messy('SELECT "column", iqr_count, iqr_pct, zscore_count, zscore_pct FROM cols WHERE inferred_type IN (\'numeric\', \'mixed\')', COLUMN_TABLE),
        "exact_duplicates": messy("SELECT n AS rows, exact_count, exact_pct, rows_in_groups FROM exact", COLUMN_TABLE),
        "duplicate_rows": messy(f"SELECT row_id, {ALL} FROM copied", COPIES),
        "duplicate_texts": "SELECT doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1",
        "near_duplicates": messy("SELECT count(*) AS near_duplicate_count, round(100.0 * count(*) / (SELECT count(*) FROM messy), 2) AS near_duplicate_pct FROM near", NEAR),
        "near_duplicate_ids": messy("SELECT row_id FROM near", NEAR),
        "near_without_id": messy("SELECT count(*) AS near_duplicate_count, round(100.0 * count(*) / (SELECT count(*) FROM messy), 2) AS near_duplicate_pct FROM near", NEAR),
        "near_wide": NEAR_WIDE,
        "near_sample": messy("SELECT row_id FROM near ORDER BY 1 LIMIT 50", NEAR),
        "duplicate_sample": messy(f"SELECT row_id, {ALL} FROM copied ORDER BY row_id LIMIT 50", COPIES),
        "pearson": f"WITH {LINE_PAIRS}, {MIRRORED} SELECT col_a, col_b, round(value, 4) AS value FROM both_ways",
        "pearson_messy": messy(f"SELECT col_a, col_b, n, round(value, 4) AS value FROM ({pearson_rows(NUMBERS, 'messy')})"),
        "pearson_wide": f"WITH {WIDE_NUMBERS} SELECT col_a, col_b, n, round(value, 4) AS value FROM ({pearson_rows({f'n{i}': f'n{i}' for i in range(30)}, 'wide_numbers')})",
        "pearson_matrix": f"WITH {LINE_PAIRS}, {MIRRORED}, four AS (SELECT col_a, col_b, round(value, 4) AS value FROM both_ways) SELECT col_a AS \"column\", "
        + ", ".join(f"max(round(value, 3)) FILTER (col_b = '{c}') AS {c}" for c in LINE_NUMBERS)
        + " FROM four GROUP BY 1",
        "contingency": "SELECT 'l_returnflag' AS col_a, 'l_linestatus' AS col_b, l_returnflag AS value_a, l_linestatus AS value_b, count(*) AS count FROM lineitem GROUP BY ALL",
        "chi2": messy(f"SELECT col_a, col_b, n, rows_a, rows_b, round(chi2, 4) AS chi2 FROM ({cramers_rows(LABELS, 'messy')})"),
        "cramers_v": messy(f"SELECT col_a, col_b, round(value, 4) AS value FROM ({cramers_rows(LABELS, 'messy')})"),
        "cramers_wide": f"WITH {WIDE_LABELS} SELECT col_a, col_b, n, round(value, 4) AS value FROM ({cramers_rows([f'g{i}' for i in range(20)], 'wide_labels')})",
        "cramers_table": f"WITH {HIGH_LINES} SELECT col_a, col_b, round(value, 4) AS cramers_v FROM ({cramers_rows(['l_returnflag', 'l_linestatus', 'ship_mode'], 'wide')})",
        "high_pairs": f"""WITH {HIGH_LINES} SELECT col_a, col_b, method, round(value, 4) AS value FROM (
          SELECT col_a, col_b, 'pearson' AS method, value FROM ({pearson_rows({c: c for c in [*LINE_NUMBERS, 'gross']}, 'wide')})
          UNION ALL SELECT col_a, col_b, 'cramers_v', value FROM ({cramers_rows(['l_returnflag', 'l_linestatus', 'flag'], 'wide')})) WHERE abs(value) >= 0.9""",
        "align_inner": 'SELECT o_orderkey AS row_id, o_totalprice AS "left", c_acctbal AS "right" FROM orders JOIN customer ON o_orderkey = c_custkey',
        "dataset_summary": messy("SELECT * FROM quality", COLUMN_TABLE),
        "quality_score": messy("SELECT quality_score FROM quality", COLUMN_TABLE),
        "quality_grade": messy("SELECT quality_grade FROM quality", COLUMN_TABLE),
        "column_warnings": messy('SELECT "column", warning FROM warned', COLUMN_TABLE),
        "recommendations": messy('SELECT severity, category, "column", message FROM ranked', COLUMN_TABLE),
        "drop_rows": messy("SELECT row_id, rating FROM messy WHERE rating IS NOT NULL"),
        "drop_column": messy("SELECT * EXCLUDE (rating) FROM messy"),
        "fill_mean": messy("SELECT row_id, round(coalesce(price, (SELECT avg(price) FROM messy)), 4) AS price FROM messy"),
        "fill_mean_text": messy("SELECT row_id, round(CASE WHEN price_text IS NULL THEN (SELECT avg(TRY_CAST(price_text AS DOUBLE)) FROM messy) ELSE TRY_CAST(price_text AS DOUBLE) END, 4) AS price_text FROM messy"),
        "convert_blanks": "SELECT o_orderkey AS row_id, CAST(o_orderkey % 1000 AS DOUBLE) AS number_text, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS flag_text, lower(o_orderpriority) AS label FROM orders",
        "fill_median": messy(f"SELECT row_id, coalesce(price, {MEDIAN_PRICE.format(source='messy')}) AS price FROM messy"),
        "fill_mode": messy("SELECT row_id, coalesce(rating, (SELECT rating FROM messy WHERE rating IS NOT NULL GROUP BY rating ORDER BY count(*) DESC, rating LIMIT 1)) AS rating FROM messy"),
        "fill_constant": messy("SELECT row_id, coalesce(price_text, '0.00') AS price_text FROM messy"),
        "ffill": fill("last"),
        "bfill": fill("first"),
        "dedup_first": dedup("min"),
        "dedup_last": dedup("max"),
        "dedup_none": dedup("min", "HAVING count(*) = 1"),
        "dedup_labels": f"WITH {CUSTOMER} SELECT DISTINCT * FROM customers",
        "to_numeric": messy("SELECT row_id, TRY_CAST(regexp_replace(price_text, '[,$%€£\\s]', '', 'g') AS DOUBLE) AS price_text FROM messy"),
        "to_numeric_currency": f"WITH {CUSTOMER} SELECT c_custkey, TRY_CAST(replace(balance_text, '$', '') AS DOUBLE) AS balance_text FROM customers",
        "to_datetime": messy(f"SELECT row_id, strftime({PARSED}, {DAY}) AS date_text FROM messy"),
        "to_categorical": messy("SELECT row_id, status FROM messy"),
        "to_string": messy("SELECT row_id, CAST(age AS VARCHAR) AS age FROM messy"),
        "to_boolean": messy("SELECT row_id, CASE WHEN lower(trim(flag_text)) IN ('true', 'yes', 'y', '1') THEN true WHEN lower(trim(flag_text)) IN ('false', 'no', 'n', '0') THEN false END AS flag_text FROM messy"),
        "to_lowercase": messy("SELECT row_id, lower(trim(priority_label)) AS priority_label FROM messy"),
        "outlier_remove": messy("SELECT row_id, price FROM messy WHERE row_id NOT IN (SELECT row_id FROM outl)", IQR_PRICE),
        "outlier_cap": messy("SELECT row_id, CASE WHEN price IS NOT NULL THEN least(greatest(price, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) END AS price FROM messy, edges", IQR_PRICE),
        "outlier_null": messy("SELECT row_id, CASE WHEN row_id NOT IN (SELECT row_id FROM outl) THEN price END AS price FROM messy", IQR_PRICE),
        "clean_pipeline": f"WITH {TIERED} SELECT row_id, {ALL} FROM cleaned",
        "clean_in_given_order": f"WITH {GIVEN} SELECT row_id, {ALL} FROM cleaned",
        "clean_log": f"""WITH {TIERED}, c AS (SELECT (SELECT count(*) FROM messy) AS n0, (SELECT count(*) FROM kept) AS n1, (SELECT count(*) FROM dense) AS n2,
            (SELECT count(*) FROM cleaned) AS n3, (SELECT count(*) FROM messy WHERE price IS NULL) AS gaps, (SELECT count(*) FROM kept WHERE rating IS NULL) AS late)
          SELECT 1 AS step, 'handle_missing' AS action, 'price' AS "column", 'fill_median' AS strategy, n0 AS rows_before, n0 AS rows_after, CAST(0 AS BIGINT) AS rows_removed, gaps AS missing_before, CAST(0 AS BIGINT) AS missing_after, CAST(NULL AS BIGINT) AS outliers_treated FROM c
          UNION ALL SELECT 2, 'fix_type', 'priority_label', 'to_lowercase', n0, n0, 0, NULL, NULL, NULL FROM c
          UNION ALL SELECT 3, 'handle_outliers', 'price', 'remove', n0, n1, n0 - n1, NULL, NULL, n0 - n1 FROM c
          UNION ALL SELECT 4, 'handle_missing', 'rating', 'drop_rows', n1, n2, n1 - n2, late, 0, NULL FROM c
          UNION ALL SELECT 5, 'remove_duplicates', NULL, 'keep_first', n2, n3, n2 - n3, NULL, NULL, NULL FROM c""",
        "strategy_options": messy(
            """SELECT "column", CASE WHEN missing_count = 0 THEN '' WHEN inferred_type IN ('numeric', 'mixed') THEN 'drop_rows,drop_column,fill_mean,fill_median,fill_mode,fill_constant,ffill,bfill'
              ELSE 'drop_rows,drop_column,fill_mode,fill_constant,ffill,bfill' END AS missing_options,
            CASE WHEN NOT type_mismatch THEN '' WHEN inferred_type = 'categorical' THEN 'numeric,datetime,categorical,string,boolean,lowercase' ELSE 'numeric,datetime,categorical,string,boolean' END AS type_options,
            CASE WHEN inferred_type IN ('numeric', 'mixed') AND iqr_count > 0 THEN 'remove,cap_iqr,replace_nan' ELSE '' END AS outlier_options FROM cols""",
            COLUMN_TABLE,
        ),
        "suggest_plan": messy(
            """SELECT CAST(row_number() OVER (ORDER BY tier, seq) AS INTEGER) AS step, action, "column", choice FROM (
              SELECT 0 AS tier, position AS seq, 'handle_missing' AS action, "column", CASE "column" WHEN 'price' THEN 'fill_median' ELSE 'fill_constant' END AS choice FROM cols WHERE "column" IN ('price', 'price_text') AND missing_count > 0
              UNION ALL SELECT 0, 100 + position, 'fix_type', "column", CASE "column" WHEN 'flag_text' THEN 'boolean' ELSE 'lowercase' END FROM cols WHERE "column" IN ('priority_label', 'flag_text') AND type_mismatch
              UNION ALL SELECT 0, 200 + position, 'handle_outliers', "column", 'cap_iqr' FROM cols WHERE inferred_type IN ('numeric', 'mixed') AND iqr_count > 0
              UNION ALL SELECT 2, position, 'handle_missing', "column", 'drop_rows' FROM cols WHERE "column" = 'rating' AND missing_count > 0
              UNION ALL SELECT 2, 300, 'remove_duplicates', NULL, 'first' FROM exact WHERE exact_count > 0)""",
            COLUMN_TABLE,
        ),
        "type_distribution": messy("SELECT inferred_type, count(*) AS columns FROM cols GROUP BY 1", COLUMN_TABLE),
        "missing_ranking": messy("SELECT \"column\", missing_pct, CASE WHEN missing_pct >= 30 THEN 'red' WHEN missing_pct >= 10 THEN 'orange' ELSE 'yellow' END AS band FROM cols WHERE missing_count > 0", COLUMN_TABLE),
        "missing_matrix": messy(
            "SELECT row_id, \"column\", missing FROM (SELECT *, max(missing) OVER (PARTITION BY \"column\") AS gappy FROM ("
            + union([f"SELECT row_id, '{c}' AS \"column\", CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS missing FROM first" for c in MESSY_COLUMNS])
            + ")) WHERE gappy = 1",
            "first AS (SELECT * FROM messy)",
        ),
        "column_summary": messy(
            """SELECT cols."column", storage_type, inferred_type, CASE WHEN type_mismatch THEN 'Yes' ELSE 'No' END AS type_mismatch, missing_count,
              concat(format('{:.1f}', missing_pct), '%') AS missing_pct, CASE WHEN missing_count = 0 THEN 'none' WHEN cols."column" IN (SELECT target FROM related) THEN 'MAR' ELSE 'MCAR' END AS pattern,
              CAST((SELECT count(*) FROM warned w WHERE w."column" = cols."column") AS INTEGER) AS warnings FROM cols""",
            COLUMN_TABLE, BISERIAL, GAP_V, PHI, RELATED,
        ),
        "headline": messy("SELECT q.rows, q.columns, q.overall_missing_pct, (SELECT count(*) FROM cols WHERE type_mismatch) AS type_mismatches, (SELECT count(*) FROM warned) AS total_warnings FROM quality q", COLUMN_TABLE),
        "column_filter": messy(
            'SELECT "column", inferred_type, type_mismatch, missing_pct, warning_count FROM (SELECT *, CAST((SELECT count(*) FROM warned w WHERE w."column" = cols."column") AS INTEGER) AS warning_count FROM cols) WHERE type_mismatch OR missing_count > 0 OR warning_count > 0',
            COLUMN_TABLE,
        ),
        "histogram": bins("SELECT l_extendedprice AS x FROM lineitem", "least(40, greatest(5, count(*) // 5))"),
        "length_histogram": bins("SELECT CAST(length(text) AS DOUBLE) AS x FROM documents", "least(30, count(DISTINCT x))"),
        "kde": """WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS n, stddev_samp(l_extendedprice) * count(*) ** -0.2 AS h FROM lineitem),
          grid AS (SELECT CAST(i AS INTEGER) AS point, lo + i * ((hi - lo) / 299) AS x, n, h FROM e, range(300) AS r(i))
          SELECT point, round(any_value(x), 4) AS x, round(sum(exp(((x - l_extendedprice) / h) ** 2 / -2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 12) AS density FROM grid, lineitem GROUP BY point""",
        "period_counts": f"SELECT 'week' AS period, strftime(date_trunc('week', ts), {DAY}) AS period_start, count(*) AS count FROM events GROUP BY 2",
        "period_counts_years": f"SELECT 'year' AS period, strftime(date_trunc('year', o_orderdate), {DAY}) AS period_start, count(*) AS count FROM orders GROUP BY 2",
        "outlier_ranking": messy('SELECT "column", inferred_type, iqr_count AS outliers, iqr_pct AS outlier_pct FROM cols WHERE inferred_type IN (\'numeric\', \'mixed\')', COLUMN_TABLE),
        "boxplot": messy('SELECT "column", round(min(x), 4) AS min, round(quantile_cont(x, 0.25), 4) AS q1, round(quantile_cont(x, 0.5), 4) AS median, round(quantile_cont(x, 0.75), 4) AS q3, round(max(x), 4) AS max FROM numbers GROUP BY 1', NUM),
        "boxplot_points": messy(
            """SELECT 'outlier' AS kind, row_id, x AS value FROM flags WHERE "column" = 'price' AND iqr
              UNION ALL (SELECT 'normal', row_id, x FROM flags WHERE "column" = 'price' AND NOT iqr
                ORDER BY (row_id % 2147483647 * 2654435761 + 42) % 4294967296, row_id LIMIT 300)""",
            NUM, FENCES, FLAGS,
        ),
        "histograms_all": " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", * FROM ({bins(f"SELECT CAST({c} AS DOUBLE) AS x FROM lineitem", "least(40, greatest(5, count(*) // 5))")})""" for c in LINE_NUMBERS
        ),
        "boxplot_points_all": messy(
            """SELECT "column", 'outlier' AS kind, row_id, x AS value FROM flags WHERE iqr
              UNION ALL (SELECT "column", 'normal', row_id, x FROM flags WHERE NOT iqr
                QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY (row_id % 2147483647 * 2654435761 + 42) % 4294967296, row_id) <= 300)""",
            NUM, FENCES, FLAGS,
        ),
        "rec_counts": messy("SELECT severity, count(*) AS count FROM ranked GROUP BY 1", COLUMN_TABLE),
        "overview_facts": messy(
            """SELECT q.rows, q.columns, q.quality_score, q.quality_grade,
              coalesce((SELECT string_agg(concat("column", ' (', format('{:.1f}', missing_pct), '%)'), ', ' ORDER BY missing_pct DESC, position) FROM (SELECT * FROM cols WHERE missing_count > 0 ORDER BY missing_pct DESC, position LIMIT 5)), 'none') AS missing_summary,
              (SELECT exact_count FROM exact) AS duplicate_count,
              (SELECT CASE WHEN count(*) > 0 THEN concat(count(*), ' column(s)') ELSE 'none' END FROM cols WHERE type_mismatch) AS type_issues,
              coalesce((SELECT string_agg(concat("column", ' (', iqr_count, ')'), ', ' ORDER BY iqr_count DESC, position) FROM (SELECT * FROM cols WHERE iqr_count > 0 ORDER BY iqr_count DESC, position LIMIT 5)), 'none detected') AS outlier_summary FROM quality q""",
            COLUMN_TABLE,
        ),
        "column_facts": messy(
            f"""SELECT cols."column", cols.inferred_type, CASE WHEN cols.inferred_type IN ('numeric', 'mixed') THEN
                concat('mean=', s.mean, ', median=', s.median, ', std=', s.std, ', min=', s.min, ', max=', s.max, ', unique_count=', s.unique_count)
                WHEN cols.inferred_type = 'datetime' THEN 'n/a' ELSE concat('unique_count=', raw) END AS stats,
              concat(format('{{:.1f}}', missing_pct), '%') AS missing, iqr_count AS outliers,
              coalesce((SELECT string_agg(warning, '; ' ORDER BY rule) FROM warned w WHERE w."column" = cols."column"), 'none') AS warnings
            FROM cols LEFT JOIN typed ON cols."column" = typed."column" LEFT JOIN ({NUMERIC_ROW}) s ON cols."column" = s."column\"""",
            COLUMN_TABLE,
        ),
        "digest": messy(
            """SELECT (SELECT string_agg(concat("column", ' (', inferred_type, CASE WHEN missing_count > 0 THEN concat(', ', format('{:.1f}', missing_pct), '% missing') ELSE '' END,
                CASE WHEN iqr_count > 0 THEN concat(', ', iqr_count, ' outliers') ELSE '' END, CASE WHEN type_mismatch THEN ', type mismatch' ELSE '' END, ')'), '; ' ORDER BY position) FROM cols) AS columns,
              coalesce((SELECT string_agg(concat("column", ' (', format('{:.1f}', missing_pct), '%)'), ', ' ORDER BY missing_pct DESC, position) FROM (SELECT * FROM cols WHERE missing_count > 0 ORDER BY missing_pct DESC, position LIMIT 5)), 'none') AS missing_summary,
              (SELECT exact_count FROM exact) AS duplicate_count,
              coalesce((SELECT string_agg(concat("column", ' (', iqr_count, ')'), ', ' ORDER BY iqr_count DESC, position) FROM (SELECT * FROM cols WHERE iqr_count > 0 ORDER BY iqr_count DESC, position LIMIT 5)), 'none detected') AS outlier_summary,
              coalesce((SELECT string_agg(concat(severity, ' — ', message), '; ' ORDER BY place) FROM (SELECT * FROM ranked ORDER BY place LIMIT 5)), 'none') AS recommendations""",
            COLUMN_TABLE,
        ),
        "issue_list": messy("SELECT concat('- [', upper(severity), ']', CASE WHEN \"column\" IS NULL THEN '' ELSE concat(' [', \"column\", ']') END, ' ', message) AS line FROM ranked", COLUMN_TABLE),
        "issue_columns": messy('SELECT "column" FROM cols WHERE missing_count > 0 OR iqr_count > 0 OR type_mismatch', COLUMN_TABLE),
        "before_after": before_after_sql(),
    }


def before_after_sql() -> str:
    """Score the messy table as above; of the cleaned one only the counts that the
    suggested plan leaves open need work: it has no gaps and no copies left."""
    numbers = {c: x for c, x in NUMBERS.items()}
    after_num = long_numbers(numbers, "cleaned")
    return f"""WITH {SUGGESTED}, {COLUMN_TABLE},
      after_n AS ({after_num}), after_f AS (SELECT "column" AS c, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM after_n GROUP BY 1),
      after_o AS (SELECT c, round(100.0 * count(*) FILTER (q3 > q1 AND (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1))) / (SELECT count(*) FROM cleaned), 2) AS pct
        FROM after_n JOIN after_f ON c = "column" GROUP BY c),
      after_missing AS (SELECT {' + '.join(f'count(*) FILTER ({c} IS NULL)' for c in MESSY_COLUMNS)} AS cells, count(*) AS n FROM cleaned),
      after_score AS (SELECT CAST(round_even(100 - least(40, 2 * round(100.0 * cells / (9 * n), 2)) - 20.0 * 2 / 9 - least(10, 2 * coalesce((SELECT avg(pct) FROM after_o WHERE pct > 0), 0)) + 5.0 * 7 / 9, 0) AS BIGINT) AS score FROM after_missing),
      pairs AS (
        SELECT 'rows' AS metric, (SELECT n FROM exact) AS before, (SELECT n FROM after_missing) AS after
        UNION ALL SELECT 'columns', 9, 9
        UNION ALL SELECT 'missing_cells', (SELECT total_missing_cells FROM quality), (SELECT cells FROM after_missing)
        UNION ALL SELECT 'exact_duplicates', (SELECT exact_count FROM exact), 0
        UNION ALL SELECT 'quality_score', (SELECT quality_score FROM quality), (SELECT score FROM after_score))
      SELECT metric, CAST(before AS VARCHAR) AS before, CAST(after AS VARCHAR) AS after, CAST(after - before AS BIGINT) AS delta FROM pairs
      UNION ALL SELECT 'quality_grade', (SELECT quality_grade FROM quality),
        (SELECT CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END FROM after_score), NULL"""
