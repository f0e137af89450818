"""The same results in SQL over the same tables, by independent formulas where there is a choice."""

from __future__ import annotations

from itertools import product

from panelweave.plans import bindings as b

ROW_KEYS = ", ".join(b.ROW_KEYS)

# --- households ----------------------------------------------------------------------------------

RELATION = "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_returnflag END"
IS_MEMBER = "(relation IS NOT NULL AND relation <> 'R')"

PEOPLE = f"""
people AS (
  SELECT *,
    {RELATION} AS relation,
    CASE WHEN l_quantity <= 5 THEN NULL ELSE l_extendedprice END AS work,
    CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice * l_discount END AS other,
    sqrt(2 + l_tax) AS work_deflator,
    sqrt(3 + l_tax) AS other_deflator
  FROM lineitem
)"""


def _households(own: str, last: str) -> str:
    return f"""
households AS (
  SELECT l_orderkey AS hh,
    CAST(count(*) FILTER (WHERE {IS_MEMBER}) AS DOUBLE) AS members,
    {own} AS own,
    {last} AS last
  FROM people GROUP BY l_orderkey
)"""


def _real(amount: str, deflator: str) -> str:
    return f"coalesce(sum({amount} * {deflator}) FILTER (WHERE {IS_MEMBER}), CAST(0 AS DOUBLE))"


QUARTERLY = _households(_real("work", "work_deflator"), _real("work", "work_deflator"))
ANNUAL = _households(
    f"{_real('work', 'work_deflator')} + {_real('other', 'other_deflator')}",
    f"{_real('work', 'other_deflator')} + {_real('other', 'other_deflator')}",
)


def _income(households: str, digits: int) -> str:
    def shown(value: str) -> str:
        return f"CASE WHEN {IS_MEMBER} THEN round({value}, {digits}) END"

    return f"""
WITH {PEOPLE}, {households}
SELECT {ROW_KEYS}, members,
  {shown("own")} AS income_own, {shown("last")} AS income_last,
  {shown("own / nullif(members, 0)")} AS pc_own, {shown("last / nullif(members, 0)")} AS pc_last
FROM people JOIN households ON hh = l_orderkey"""


def _first_parent(sex: int, name: str) -> str:
    return f"""
{name}_candidates AS (
  SELECT l_orderkey, school, match,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(b.PERSON_ORDER)}) AS place
  FROM (SELECT *, (sex = {sex} AND l_linenumber IN (1, 2, 6)) AS match FROM coded)
  WHERE match IS NULL OR match
),
{name} AS (
  SELECT l_orderkey, max(CASE WHEN place = 1 AND match THEN school END) AS edu
  FROM {name}_candidates GROUP BY l_orderkey HAVING bool_or(match)
)"""


PARENT_MAX = f"""
WITH coded AS (
  SELECT *,
    CASE WHEN l_tax > 0.075 THEN NULL WHEN l_linestatus = 'F' THEN 2 ELSE 1 END AS sex,
    nullif(CAST(l_quantity AS INTEGER), 13) AS school
  FROM lineitem
), {_first_parent(2, "mother")}, {_first_parent(1, "father")}
SELECT {ROW_KEYS}, m.edu AS mother_edu, f.edu AS father_edu, greatest(m.edu, f.edu) AS parent_max
FROM lineitem LEFT JOIN mother m USING (l_orderkey) LEFT JOIN father f USING (l_orderkey)"""

_WHEN_REGION = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in b.REGION_NAMES.items())
REGION_RECODE = f"""
SELECT CASE substr(CAST(l_partkey AS VARCHAR), 1, 1) {_WHEN_REGION} END AS region,
  count(*) AS n, round(sum(l_quantity), 2) AS quantity
FROM lineitem GROUP BY 1"""

CATEGORY_RECODE = """
SELECT p_partkey, CASE WHEN p_type IN ('MEDIUM', 'LARGE') THEN 'MEDIUM OR LARGE'
  WHEN p_type IN ('SMALL', 'ECONOMY') THEN p_type END AS category
FROM part"""

PERSON_KEY = """
SELECT o_orderkey,
  CAST(o_custkey AS VARCHAR) || coalesce(nullif(o_orderstatus, 'P'), 'NA') || CAST(year(o_orderdate) AS VARCHAR)
    AS household_id,
  CAST(o_custkey AS VARCHAR) || '_' || coalesce(nullif(o_orderstatus, 'P'), 'NA') || '_' || CAST(o_orderkey AS VARCHAR)
    AS person_id
FROM orders"""

AUDIENCE_FLAGS = f"""
WITH {PEOPLE}, {ANNUAL},
roles AS (
  SELECT *,
    CASE WHEN {IS_MEMBER} THEN last / nullif(members, 0) END AS pc,
    CASE WHEN l_linenumber = 5 THEN NULL ELSE l_linestatus END = 'O' AS in_course,
    members = 1 AS alone,
    CASE WHEN l_discount = 0 THEN NULL ELSE l_discount >= 0.09 END OR l_tax > 0.075 AS benefit,
    CASE WHEN l_linenumber = 6 THEN 'started' WHEN l_linestatus = 'O' THEN 'completed' END AS schooling,
    nullif(l_returnflag, 'N') AS sector,
    l_quantity BETWEEN 14 AND 24 AS young,
    l_quantity BETWEEN 25 AND 40 AS adult
  FROM people JOIN households ON hh = l_orderkey
)
SELECT {ROW_KEYS},
  CAST(coalesce(young AND in_course AND pc <= 30000 AND NOT alone, false) AS INTEGER) AS target_quarterly,
  CAST(coalesce(young AND pc <= 30000 AND schooling IN ('completed', 'started'), false) AS INTEGER)
    AS potential_quarterly,
  CAST(coalesce(young AND in_course AND (pc <= 30000 OR benefit) AND NOT alone, false) AS INTEGER) AS target_annual,
  CAST(coalesce((young AND (pc <= 30000 OR benefit) AND schooling = 'completed') OR schooling = 'started', false)
    AS INTEGER) AS potential_annual,
  CAST(coalesce(adult AND sector <> 'A', false) AS INTEGER) AS wage_sample,
  CAST(coalesce(adult AND (sector IS NULL OR sector <> 'A'), false) AS INTEGER) AS selection_sample
FROM roles"""

HOURLY_WAGE = f"""
WITH pay AS (
  SELECT {ROW_KEYS},
    CASE WHEN l_quantity <= 5 THEN NULL WHEN l_tax = 0 THEN CAST(0 AS DOUBLE) ELSE l_extendedprice END AS wage,
    nullif(l_quantity, 10) * l_discount AS hours
  FROM lineitem
), rate AS (
  SELECT *, wage / nullif(hours * CAST(4.3 AS DOUBLE), 0) AS per_hour FROM pay
), logs AS (
  SELECT *, CASE WHEN per_hour = 0 THEN CAST(0 AS DOUBLE) WHEN per_hour > 0 THEN round(ln(per_hour), 8) END AS log_hourly
  FROM rate
)
SELECT {ROW_KEYS}, round(per_hour, 6) AS hourly, log_hourly, coalesce(log_hourly, 0) AS log_hourly_or_zero,
  CASE WHEN wage > 0 THEN 1 ELSE 0 END AS employed
FROM logs"""

# --- sources -------------------------------------------------------------------------------------

DEFLATOR_JOIN = """
SELECT c_custkey, CASE WHEN n_regionkey <> 4 THEN 1 + n_nationkey / CAST(100 AS DOUBLE) END AS deflator,
  CASE WHEN n_regionkey <> 4 THEN round(c_acctbal * (1 + n_nationkey / CAST(100 AS DOUBLE)), 4) END AS real
FROM customer JOIN nation ON n_nationkey = c_nationkey"""

LABEL_DECODE = """
SELECT c_custkey, c_nationkey AS nation_code, CASE WHEN n_nationkey <> 3 THEN n_name END AS nation
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey"""

QUARTERLY_WAVES = """
SELECT CASE WHEN year(o_orderdate) = 1998 THEN 5 ELSE CAST(quarter(o_orderdate) AS INTEGER) END AS wave,
  CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
  count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1998-04-01'
GROUP BY 1, 2, 3"""

ANNUAL_FILES = """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders WHERE year(o_orderdate) IN (1996, 1997, 1999) AND o_orderpriority LIKE '1%' GROUP BY 1"""

FIXED_WIDTH_READ = """
SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice
FROM orders"""

# --- panel ---------------------------------------------------------------------------------------

PANEL = """
panel AS (
  SELECT *, CAST(year(o_orderdate) - 1994 AS INTEGER) AS wave,
    CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE substr(o_orderpriority, 1, 1) END AS grade
  FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 2001
),
latest AS (
  SELECT * FROM panel
  QUALIFY row_number() OVER (PARTITION BY o_custkey, wave ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
)"""

BASELINE_COHORT = f"""
WITH {PANEL}
SELECT o_orderkey, o_custkey FROM panel
WHERE wave = 1 AND o_custkey % 100 <> 99 AND o_orderstatus = 'F'
  AND (o_orderpriority LIKE '1%' OR grade IN ('2', '3') OR grade IS NULL)"""

PAIRS = f"""
{PANEL},
gone AS (
  SELECT x.o_custkey, x.wave FROM latest x JOIN latest y ON x.o_custkey = y.o_custkey AND y.wave = x.wave + 1
  WHERE x.grade IS NOT NULL AND x.o_orderstatus = 'F' AND y.o_orderstatus = 'P'
)"""



def _survival(last: int) -> str:
    """One step per wave after the first: who is left goes on to the next."""
    steps = ["base AS (SELECT o_custkey FROM latest WHERE wave = 1 AND o_orderstatus = 'F')"]
    ends = []
    for w in range(2, last + 1):
        alive = "base" if w == 2 else f"(SELECT o_custkey FROM step{w - 1} WHERE s <> 'P')"
        steps.append(
            f"step{w} AS (SELECT a.o_custkey, l.o_orderstatus AS s FROM {alive} a "
            f"LEFT JOIN (SELECT * FROM latest WHERE wave = {w}) l USING (o_custkey))"
        )
        ends.append(f"SELECT o_custkey, 1 AS status, {w} AS time FROM step{w} WHERE s = 'P'")
        ends.append(f"SELECT o_custkey, 0, {w - 1} FROM step{w} WHERE s IS NULL")
    ends.append(f"SELECT o_custkey, 0, {last} FROM step{last} WHERE s <> 'P'")
    return f"{PANEL}, {', '.join(steps)}, survival AS ({' UNION ALL '.join(ends)})"


SURVIVAL = _survival(b.WAVES[-1])

RAW = """
raw AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, o_orderkey, o_orderstatus,
    CASE WHEN o_orderkey % 25 <> 2 THEN round(o_totalprice, 2) END AS o_totalprice,
    CASE o_orderkey % 25 WHEN 1 THEN 'unreadable o_totalprice' WHEN 3 THEN 'short' WHEN 4 THEN 'long' END AS problem
  FROM orders WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1997-07-01'
)"""

MONTHLY = """
monthly AS (
  SELECT l_suppkey, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS wave,
    bool_and(l_quantity > 10) AS gone, bool_or(l_quantity <= 10 AND l_tax > 0.02) AS starts
  FROM lineitem WHERE year(l_shipdate) BETWEEN 1995 AND 1999 GROUP BY ALL
)"""

MONTHLY_SURVIVAL = f"""
WITH {MONTHLY},
ends AS (
  SELECT m.l_suppkey, min(CASE WHEN n.gone IS NULL OR n.gone THEN g.wave END) AS last
  FROM monthly m CROSS JOIN range(2, 61) AS g(wave) LEFT JOIN monthly n ON n.l_suppkey = m.l_suppkey AND n.wave = g.wave
  WHERE m.wave = 1 AND NOT m.gone GROUP BY m.l_suppkey
)
SELECT e.l_suppkey, CASE WHEN n.gone THEN 1 ELSE 0 END AS status,
  CAST(CASE WHEN last IS NULL THEN 60 WHEN n.gone THEN last ELSE last - 1 END AS INTEGER) AS time
FROM ends e LEFT JOIN monthly n ON n.l_suppkey = e.l_suppkey AND n.wave = e.last"""

MONTHLY_DROPOUT = f"""
WITH {MONTHLY}
SELECT x.l_suppkey, CAST(x.wave AS INTEGER) AS wave FROM monthly x JOIN monthly y ON x.l_suppkey = y.l_suppkey AND y.wave = x.wave + 1
WHERE x.starts AND y.gone"""

COVARIATES = """
covariates AS (
  SELECT c_custkey AS o_custkey, c_mktsegment AS segment,
    CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN c_mktsegment
      WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'HOME' END AS "group",
    c_acctbal AS balance
  FROM customer
)"""

MATCHED_WAVES = f"""
WITH {PANEL}, states AS (
  SELECT o_custkey, wave, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 0 END AS state, o_totalprice AS price
  FROM latest
)
SELECT o_custkey, x.state AS state_x, x.price AS price_x, y.state AS state_y, y.price AS price_y
FROM (SELECT * FROM states WHERE wave = 1) x JOIN (SELECT * FROM states WHERE wave = 2) y USING (o_custkey)"""

EVASION = f"""
WITH {PANEL}
SELECT x.o_custkey,
  CASE WHEN x.o_orderstatus = 'F' AND y.o_orderstatus = 'P' AND NOT (x.grade = '3' AND y.grade IS NULL) THEN 1 ELSE 0 END
    AS evaded
FROM latest x JOIN latest y ON x.o_custkey = y.o_custkey AND x.wave = 1 AND y.wave = 2
WHERE x.grade IN ('1', '2', '3') AND (y.grade IN ('1', '2', '3') OR y.grade IS NULL)"""

# --- estimates -----------------------------------------------------------------------------------

DOMAINS = {
    "target": "l_quantity BETWEEN 14 AND 24 AND l_linestatus = 'O'",
    "potential": "l_discount >= 0.09",
    "public": "nullif(l_returnflag, 'N') = 'A'",
}
FLAG = "l_returnflag"
STATUS = "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_linestatus END"
LINE = "CAST(l_linenumber AS VARCHAR)"
PRICE = "CASE WHEN l_quantity <= 5 THEN NULL ELSE l_extendedprice END"
DESIGN = """
design AS (
  SELECT *, 1 + l_quantity / 10 AS w, l_suppkey % 10 AS psu, CAST(year(l_shipdate) AS INTEGER) AS year FROM lineitem
)"""
POSTSTRATIFIED = """
design AS (
  SELECT * EXCLUDE (raw), raw * CASE l_returnflag WHEN 'N' THEN 230000 ELSE 120000 END
    / sum(raw) OVER (PARTITION BY l_returnflag) AS w
  FROM (SELECT *, 1 + l_quantity / 10 AS raw, l_suppkey % 10 AS psu FROM lineitem)
)"""


def _points(parts, domains=None, by="", digits=6, source="design") -> str:
    """A union of one plain aggregate per (sub-population, statistic); parts are (stat, var, expression)."""
    keys = f"{by}, " if by else ""
    selects = []
    for name, condition in (domains or DOMAINS).items():
        for stat, var, value in parts:
            head = f"SELECT {keys}'{name}' AS subpop, '{stat}' AS stat, '{var}' AS var"
            where = f"FROM {source} WHERE ({condition})"
            group = f"GROUP BY {by}" if by else ""
            if stat == "total":
                selects.append(f"{head}, CAST(NULL AS VARCHAR) AS level, round(sum(w), {digits}) AS value {where} {group}")
            elif stat == "mean":
                selects.append(
                    f"{head}, CAST(NULL AS VARCHAR) AS level, round(sum(w * ({value})) / sum(w), {digits}) AS value "
                    f"{where} AND ({value}) IS NOT NULL {group}"
                )
            else:
                over = f"OVER (PARTITION BY {by})" if by else "OVER ()"
                share = "sum(w)" if stat == "total_by" else f"sum(w) / sum(sum(w)) {over}"
                selects.append(
                    f"{head}, {value} AS level, round({share}, {digits}) AS value "
                    f"{where} AND ({value}) IS NOT NULL GROUP BY {keys}{value}"
                )
    return "\nUNION ALL\n".join(selects)


BATCH_PARTS = (
    ("total", "count", ""), ("total_by", "flag", FLAG), ("share", "flag", FLAG), ("share", "status", STATUS),
    ("share", "line", LINE), ("mean", "price", PRICE), ("mean", "discount", "l_discount"),
)

_ZERO_ROWS = "\nUNION ALL\n".join(
    f"SELECT '{name}', 'share', 'flag_status', f.x || '.Z', 0 FROM (VALUES ('A'), ('N'), ('R')) f(x)" for name in DOMAINS
)
_ABSENT_PUBLIC = """
UNION ALL SELECT 'target', 'share', 'flag_status', f.x || '.F', 0 FROM (VALUES ('A'), ('N'), ('R')) f(x)
UNION ALL SELECT 'public', 'share', 'flag_status', f.x || '.' || s.x, 0
FROM (VALUES ('N'), ('R')) f(x), (VALUES ('F'), ('O')) s(x)"""
SVY_INTERACTION = f"""
WITH {DESIGN}
{_points([("share", "flag_status", "l_returnflag || '.' || l_linestatus")])}
UNION ALL {_ZERO_ROWS} {_ABSENT_PUBLIC}"""

SE_CASES = (
    ("total", "count", None, "1", "1"),
    *[("share", "flag", v, "1", f"CASE WHEN l_returnflag = '{v}' THEN 1 ELSE 0 END") for v in "ANR"],
    *[
        ("share", "status", v, "CASE WHEN l_linenumber = 3 THEN 0 ELSE 1 END",
         f"CASE WHEN l_linenumber <> 3 AND l_linestatus = '{v}' THEN 1 ELSE 0 END")
        for v in "FO"
    ],
    ("mean", "price", None, "CASE WHEN l_quantity <= 5 THEN 0 ELSE 1 END",
     "CASE WHEN l_quantity <= 5 THEN 0 ELSE l_extendedprice END"),
)


def _long(extra: str) -> str:
    """Every row of the design once per estimate, with x and y zero outside the sub-population."""
    selects = []
    for name, condition in DOMAINS.items():
        for stat, var, level, x, y in SE_CASES:
            shown = "NULL" if level is None else f"'{level}'"
            inside = f"coalesce(({condition}), false)"
            selects.append(
                f"SELECT '{name}' AS subpop, '{stat}' AS stat, '{var}' AS var, {shown} AS level, {extra}, w,"
                f" CAST(CASE WHEN {inside} THEN {x} ELSE 0 END AS DOUBLE) AS x,"
                f" CAST(CASE WHEN {inside} THEN {y} ELSE 0 END AS DOUBLE) AS y FROM design"
            )
    return "long AS (" + "\nUNION ALL\n".join(selects) + ")"


_KEYS = "subpop, stat, var, level"
_SAME = " AND ".join(f"p.{k} IS NOT DISTINCT FROM l.{k}" for k in ("subpop", "stat", "var", "level"))
# A category nobody in the sub-population has is no estimate.
_POINTS = f"""
points AS (
  SELECT {_KEYS}, CASE WHEN stat = 'total' THEN sum(w * y) ELSE sum(w * y) / sum(w * x) END AS value,
    CASE WHEN stat = 'total' THEN 1 ELSE sum(w * x) END AS bottom
  FROM long GROUP BY {_KEYS} HAVING sum(w * y) <> 0
)"""
_U = "CASE WHEN l.stat = 'total' THEN l.y ELSE (l.y - p.value * l.x) / p.bottom END"
_SE_END = f"""
strata AS (SELECT {_KEYS}, h, count(*) * var_samp(z) AS v FROM clusters GROUP BY {_KEYS}, h)
SELECT p.subpop, p.stat, p.var, p.level, round(p.value, 4) AS value, round(sqrt(sum(l.v)), 4) AS std_error
FROM strata l JOIN points p ON {_SAME} GROUP BY p.subpop, p.stat, p.var, p.level, p.value"""

SVY_SE_TAYLOR = f"""
WITH {DESIGN}, {_long("l_linenumber AS h, psu")}, {_POINTS},
clusters AS (
  SELECT l.subpop, l.stat, l.var, l.level, h, psu, sum(l.w * {_U}) AS z FROM long l JOIN points p ON {_SAME}
  GROUP BY l.subpop, l.stat, l.var, l.level, h, psu
), {_SE_END}"""

SVY_SE_POSTSTRATIFIED = f"""
WITH {POSTSTRATIFIED}, {_long("l_linenumber AS h, psu, l_returnflag AS g")}, {_POINTS},
scores AS (
  SELECT l.subpop, l.stat, l.var, l.level, h, psu, g, l.w, {_U} AS u FROM long l JOIN points p ON {_SAME}
),
means AS (SELECT {_KEYS}, g, sum(w * u) / sum(w) AS mean_u FROM scores GROUP BY {_KEYS}, g),
clusters AS (
  SELECT l.subpop, l.stat, l.var, l.level, h, psu, sum(l.w * (l.u - p.mean_u)) AS z
  FROM scores l JOIN means p ON {_SAME} AND p.g = l.g
  GROUP BY l.subpop, l.stat, l.var, l.level, h, psu
), {_SE_END}"""


def _replicate_sql() -> str:
    weights = ", ".join(
        f"w * (1 + ((l_orderkey * {r + 1}) % 7 - 3) / CAST(10 AS DOUBLE)) AS w{r}" for r in range(1, b.REPLICATES + 1)
    )
    names = [f"w{r}" for r in range(1, b.REPLICATES + 1)]
    values = ", ".join(
        f"CASE WHEN stat = 'total' THEN sum({n} * y) ELSE sum({n} * y) / sum({n} * x) END AS e_{n}" for n in names
    )
    squares = " + ".join(f"(e_{n} - value) ** 2" for n in names)
    design = DESIGN.replace("FROM lineitem", "FROM lineitem").strip()
    return f"""
WITH {design}, weighted AS (SELECT *, {weights} FROM design),
{_long(", ".join(names)).replace("FROM design", "FROM weighted")},
points AS (
  SELECT {_KEYS}, CASE WHEN stat = 'total' THEN sum(w * y) ELSE sum(w * y) / sum(w * x) END AS value, {values}
  FROM long GROUP BY {_KEYS} HAVING sum(w * y) <> 0
)
SELECT {_KEYS}, round(value, 4) AS value, round(sqrt(({squares}) / {len(names)}), 4) AS std_error FROM points"""


SVY_SE_BOOTSTRAP = f"""
WITH {DESIGN}, {_long("l_linenumber AS h, psu")},
cells AS (SELECT {_KEYS}, h, psu, sum(w * y) AS y, sum(w * x) AS x FROM long GROUP BY {_KEYS}, h, psu),
points AS (
  SELECT {_KEYS}, CASE WHEN stat = 'total' THEN sum(y) ELSE sum(y) / sum(x) END AS value
  FROM cells GROUP BY {_KEYS} HAVING sum(y) <> 0
),
places AS (
  SELECT h, psu, row_number() OVER (PARTITION BY h ORDER BY psu) AS number, count(*) OVER (PARTITION BY h) AS n
  FROM (SELECT DISTINCT l_linenumber AS h, psu FROM design)
),
draws AS (
  SELECT h, r, 1 + CAST('0x' || substr(md5(concat_ws('|', {b.BOOTSTRAP_SEED}, h, r, number - 1)), 1, 13) AS BIGINT) % n AS number
  FROM places, range(1, {b.BOOTSTRAP + 1}) AS t(r) WHERE number > 1
),
factors AS (
  SELECT h, psu, r, count(*) * any_value(n) / CAST(any_value(n) - 1 AS DOUBLE) AS f
  FROM draws JOIN places USING (h, number) GROUP BY h, psu, r
),
drawn AS (
  SELECT {_KEYS}, r, CASE WHEN stat = 'total' THEN sum(f * y) ELSE sum(f * y) / nullif(sum(f * x), 0) END AS e
  FROM cells JOIN factors USING (h, psu) GROUP BY {_KEYS}, r
)
SELECT p.subpop, p.stat, p.var, p.level, round(value, 4) AS value, round(sqrt(avg((e - value) ** 2)), 4) AS std_error
FROM points p JOIN drawn l ON {_SAME} GROUP BY p.subpop, p.stat, p.var, p.level, value"""


# --- survival ------------------------------------------------------------------------------------


def _curve(source: str) -> str:
    return f"""
counts AS (
  SELECT population, stratum, time, CAST(sum(status) AS BIGINT) AS n_event, CAST(sum(1 - status) AS BIGINT) AS n_censor
  FROM {source} GROUP BY ALL
),
risk AS (
  SELECT *, CAST(sum(n_event + n_censor) OVER (PARTITION BY population, stratum ORDER BY time DESC) AS BIGINT) AS n_risk
  FROM counts
),
curve AS (
  SELECT *, product(1 - n_event / n_risk) OVER (PARTITION BY population, stratum ORDER BY time) AS s,
    sqrt(sum(n_event / nullif(CAST(n_risk AS DOUBLE) * (n_risk - n_event), 0))
      OVER (PARTITION BY population, stratum ORDER BY time)) AS e
  FROM risk
)
SELECT population, stratum, time, n_risk, n_event, n_censor, round(s, 8) AS surv,
  CASE WHEN s > 0 THEN round(s * e, 8) END AS std_error,
  CASE WHEN s > 0 THEN round(s * exp(-1.959963984540054 * e), 8) END AS lower,
  CASE WHEN s > 0 THEN round(least(s * exp(1.959963984540054 * e), 1), 8) END AS upper
FROM curve"""


KM_CURVE = f"""
WITH {SURVIVAL}, people AS (SELECT *, 'all' AS population, 'all' AS stratum FROM survival), {_curve("people")}"""

KM_CURVE_BY = f"""
WITH {SURVIVAL}, {COVARIATES},
joined AS (SELECT *, "group" AS stratum FROM survival JOIN covariates USING (o_custkey) WHERE "group" IS NOT NULL),
people AS (
  SELECT *, 'all' AS population FROM joined
  UNION ALL SELECT *, 'solvent' AS population FROM joined WHERE balance > 0
), {_curve("people")}"""

# Newton's method on the Efron likelihood of one 0/1 covariate, from the counts at each event time.
COX_ONE_BINARY = f"""
WITH RECURSIVE {SURVIVAL}, {COVARIATES},
people AS (SELECT time, status, CASE WHEN balance > 4000 THEN 1 ELSE 0 END AS x
  FROM survival JOIN covariates USING (o_custkey)),
times AS (SELECT DISTINCT time AS t FROM people WHERE status = 1),
counts AS (
  SELECT t, CAST(count(*) FILTER (WHERE time >= t AND x = 1) AS DOUBLE) AS n1,
    CAST(count(*) FILTER (WHERE time >= t AND x = 0) AS DOUBLE) AS n0,
    CAST(count(*) FILTER (WHERE time = t AND status = 1 AND x = 1) AS DOUBLE) AS d1,
    CAST(count(*) FILTER (WHERE time = t AND status = 1 AND x = 0) AS DOUBLE) AS d0
  FROM people, times GROUP BY t
),
ties AS (SELECT *, CAST(unnest(range(CAST(d1 + d0 AS BIGINT))) AS DOUBLE) / (d1 + d0) AS part FROM counts),
newton AS (
  SELECT 0 AS step, CAST(0 AS DOUBLE) AS beta, CAST(1 AS DOUBLE) AS information
  UNION ALL
  SELECT step + 1,
    beta + (any_value((SELECT sum(d1) FROM counts)) - sum(p)) / sum(p * (1 - p)),
    sum(p * (1 - p))
  FROM (
    SELECT step, beta, exp(beta) * (n1 - part * d1) / (exp(beta) * (n1 - part * d1) + n0 - part * d0) AS p
    FROM newton, ties WHERE step < 8
  ) GROUP BY step, beta
)
SELECT 'solvent' AS term, round(beta, 6) AS estimate, round(1 / sqrt(information), 6) AS std_error
FROM newton WHERE step = 8"""

# --- regression ----------------------------------------------------------------------------------

FLAG_LEVELS = (("(Intercept)", "A"), ("flagN", "N"), ("flagR", "R"))
_TERM_SE = "sqrt(sum(v))"


def _factor_fit(column: str, levels, source: str, stratum: str, y: str, link=None) -> str:
    """A saturated model of one factor: differences of (transformed) weighted means, with linearised errors."""
    values = ", ".join(f"('{term}', '{level}')" for term, level in levels)
    base = levels[0][1]
    eta, slope = link or ("m", "1")
    return f"""
terms(term, level) AS (VALUES {values}),
means AS (SELECT {column} AS level, sum(w * ({y})) / sum(w) AS m, sum(w) AS size FROM {source} GROUP BY 1),
etas AS (SELECT level, m, size, {eta} AS eta, {slope} AS slope FROM means),
scores AS (
  SELECT term, terms.level AS level, {stratum} AS h, psu,
    w * (({y}) - e.m) / e.size / e.slope
      * CASE WHEN {column} = terms.level THEN 1 ELSE -1 END AS u
  FROM {source}, terms, etas e
  WHERE e.level = {column} AND ({column} = terms.level OR {column} = '{base}')
),
clusters AS (
  SELECT term, h, psu, sum(u) AS z FROM (
    SELECT term, h, psu, u FROM scores
    UNION ALL SELECT DISTINCT term, {stratum}, psu, 0 FROM {source}, terms
  ) GROUP BY term, h, psu
),
strata AS (SELECT term, h, count(*) * var_samp(z) AS v FROM clusters GROUP BY term, h),
errors AS (SELECT term, sqrt(sum(v)) AS se FROM strata GROUP BY term),
fit AS (
  SELECT term, CASE WHEN terms.level = '{base}' THEN e.eta ELSE e.eta - (SELECT eta FROM etas WHERE level = '{base}') END
    AS estimate, se
  FROM terms JOIN etas e ON e.level = terms.level JOIN errors USING (term)
)"""


def _number_fit(domain: str, group: str | None) -> str:
    """A straight line: weighted slope and intercept, with linearised errors over all clusters."""
    mean_u = "sum(w * u) OVER (PARTITION BY term, g) / sum(w) OVER (PARTITION BY term, g)" if group else "0"
    return f"""
rows AS (SELECT *, CASE WHEN {domain} THEN w ELSE 0 END AS dw, ln(l_extendedprice) AS y, l_quantity AS x FROM design),
means AS (SELECT sum(dw * x) / sum(dw) AS mx, sum(dw * y) / sum(dw) AS my, sum(dw) AS size FROM rows),
line AS (
  SELECT mx, my, size, sum(dw * (x - mx) * (x - mx)) AS sxx,
    sum(dw * (x - mx) * (y - my)) / sum(dw * (x - mx) * (x - mx)) AS slope
  FROM rows, means GROUP BY mx, my, size
),
parts AS (
  SELECT l_linenumber AS h, psu, {group or "0"} AS g, w, dw / w * (y - my - slope * (x - mx)) AS e,
    x, mx, sxx, size FROM rows, line
),
scores AS (
  SELECT 'quantity' AS term, h, psu, g, w, e * (x - mx) / sxx AS u FROM parts
  UNION ALL SELECT '(Intercept)', h, psu, g, w, e / size - mx * e * (x - mx) / sxx FROM parts
),
centred AS (SELECT term, h, psu, w * (u - {mean_u}) AS u FROM scores),
clusters AS (SELECT term, h, psu, sum(u) AS z FROM centred GROUP BY term, h, psu),
strata AS (SELECT term, h, count(*) * var_samp(z) AS v FROM clusters GROUP BY term, h),
errors AS (SELECT term, sqrt(sum(v)) AS se FROM strata GROUP BY term),
fit AS (
  SELECT term, CASE term WHEN 'quantity' THEN slope ELSE my - slope * mx END AS estimate, se FROM errors, line
)"""


_SHOW_FIT = """
SELECT term, round(estimate, 6) AS estimate, round(se, 6) AS std_error, round(estimate / se, 6) AS statistic FROM fit"""
_LOG_PRICE = "ln(l_extendedprice)"
_FACTOR = _factor_fit("l_returnflag", FLAG_LEVELS, "design", "l_linenumber", _LOG_PRICE)
WLS_ONE_FACTOR = f"WITH {DESIGN}, {_FACTOR} {_SHOW_FIT}"
WLS_ONE_NUMBER = f"WITH {DESIGN}, {_number_fit('true', None)} {_SHOW_FIT}"
WLS_SANDWICH_SE = f"WITH {POSTSTRATIFIED}, {_number_fit('l_discount >= 0.09', 'l_returnflag')} {_SHOW_FIT}"


# Effects of levels from means within each level; a level's error is that of its mean less the slope's share.
WLS_MANY_LEVELS = f"""
WITH {DESIGN},
rows AS (
  SELECT l_partkey % 2000 AS level, l_linenumber AS h, psu, w, ln(l_extendedprice) AS y, l_quantity AS x FROM design
),
means AS (SELECT level, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w) AS size FROM rows GROUP BY level),
line AS (
  SELECT sum(w * (x - mx) * (x - mx)) AS sxx, sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) AS slope
  FROM rows JOIN means USING (level)
),
parts AS (
  SELECT level, h, psu, size, w * (y - my - slope * (x - mx)) AS e, (x - mx) / sxx AS lever
  FROM rows JOIN means USING (level), line
),
places AS (SELECT h, psu, sum(e * lever) AS slope_z FROM parts GROUP BY h, psu),
own AS (SELECT level, h, psu, sum(e / size) AS z FROM parts GROUP BY level, h, psu),
base AS (SELECT level, mx, my FROM means WHERE level = (SELECT min(level) FROM means)),
clusters AS (
  SELECT 'quantity' AS term, h, psu, slope_z AS z FROM places
  UNION ALL SELECT '(Intercept)', places.h, places.psu, coalesce(z, 0) - mx * slope_z
  FROM places CROSS JOIN base LEFT JOIN own f ON f.level = base.level AND f.h = places.h AND f.psu = places.psu
  UNION ALL SELECT 'part' || m.level, places.h, places.psu, coalesce(o.z, 0) - coalesce(f.z, 0) - (m.mx - base.mx) * slope_z
  FROM places CROSS JOIN base JOIN means m ON m.level <> base.level
    LEFT JOIN own o ON o.level = m.level AND o.h = places.h AND o.psu = places.psu
    LEFT JOIN own f ON f.level = base.level AND f.h = places.h AND f.psu = places.psu
),
strata AS (SELECT term, h, count(*) * var_samp(z) AS v FROM clusters GROUP BY term, h),
errors AS (SELECT term, sqrt(sum(v)) AS se FROM strata GROUP BY term),
estimates AS (
  SELECT 'quantity' AS term, slope AS estimate FROM line
  UNION ALL SELECT '(Intercept)', my - slope * mx FROM base, line
  UNION ALL SELECT 'part' || m.level, (m.my - slope * m.mx) - (base.my - slope * base.mx)
  FROM line, base JOIN means m ON m.level <> base.level
)
SELECT term, round(estimate, 6) AS estimate, round(se, 6) AS std_error, true AS converged
FROM estimates JOIN errors USING (term)"""

# Student's t with an even number of degrees of freedom has a finite series in the angle.
_TAX_FIT = _number_fit("true", None).replace("l_quantity AS x", "l_tax AS x").replace("'quantity'", "'tax'")
WLS_SIGNIFICANCE = f"""
WITH {DESIGN}, {_TAX_FIT},
freedom AS (SELECT count(*) - count(DISTINCT h) + 1 - 2 AS df FROM (SELECT DISTINCT h, psu FROM parts)),
angles AS (SELECT *, atan(abs(estimate / se) / sqrt(df)) AS angle FROM fit, freedom),
series AS (
  SELECT k, exp(sum(CASE WHEN k = 0 THEN 0 ELSE ln((2 * k - 1) / (2 * k)) END) OVER (ORDER BY k)) AS factor
  FROM (SELECT unnest(range(0, 1000)) AS k)
),
tails AS (
  SELECT term, 1 - sin(any_value(angle)) * sum(factor * cos(angle) ** (2 * k)) AS p
  FROM angles JOIN series ON 2 * k <= df - 2 WHERE df % 2 = 0 GROUP BY term
)
SELECT 'tax' AS model, term, round(estimate, 6) AS estimate, round(se, 6) AS std_error,
  round(estimate / se, 6) AS statistic, round(p, 6) AS p_value, true AS converged
FROM fit LEFT JOIN tails USING (term)"""


def _several_terms(terms: dict[str, str], y: str, source: str = "design", extra: str = "") -> str:
    """Least squares of several terms: each coefficient from its term made orthogonal to all others."""
    names = list(terms)
    steps = [
        f"c AS (SELECT {extra} l_linenumber AS h, psu, w, {y} AS y, "
        + ", ".join(f"CAST({e} AS DOUBLE) AS c{i}" for i, e in enumerate(terms.values()))
        + f" FROM {source})"
    ]
    source = "c"
    for k in range(len(names)):
        order = [i for i in range(len(names)) if i != k] + [k]
        for place, i in enumerate(order):
            column = f"z{k}" if i == k else f"u{k}_{i}"
            parts = "".join(
                f" - sum(w * c{i} * u{k}_{j}) OVER () / sum(w * u{k}_{j} * u{k}_{j}) OVER () * u{k}_{j}" for j in order[:place]
            )
            name = f"o{k}_{place}"
            steps.append(f"{name} AS (SELECT *, c{i}{parts} AS {column} FROM {source})")
            source = name
        drop = ", ".join(f"u{k}_{i}" for i in order[:-1])
        steps.append(f"o{k} AS (SELECT * EXCLUDE ({drop}), sum(w * z{k} * y) OVER () / sum(w * z{k} * z{k}) OVER () AS b{k} FROM {source})")
        source = f"o{k}"
    fitted = " + ".join(f"b{k} * c{k}" for k in range(len(names)))
    steps.append(f"e AS (SELECT *, y - ({fitted}) AS e FROM {source})")
    scores = " UNION ALL ".join(
        f"SELECT '{n}' AS term, b{k} AS estimate, h, psu, w * z{k} * e / sum(w * z{k} * z{k}) OVER () AS u FROM e"
        for k, n in enumerate(names)
    )
    return ", ".join(steps) + f""",
scores AS ({scores}),
clusters AS (SELECT term, any_value(estimate) AS estimate, h, psu, sum(u) AS z FROM scores GROUP BY term, h, psu),
strata AS (SELECT term, any_value(estimate) AS estimate, h, count(*) * var_samp(z) AS v FROM clusters GROUP BY term, h),
fit AS (SELECT term, any_value(estimate) AS estimate, sqrt(sum(v)) AS se FROM strata GROUP BY term)"""


_MINCER_TERMS = {
    "(Intercept)": "1",
    "flagN": "CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END",
    "flagR": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END",
    "statusO": "CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END",
    "quantity": "l_quantity",
}
MINCER_FIT = f"WITH {DESIGN}, {_several_terms(_MINCER_TERMS, _LOG_PRICE)} {_SHOW_FIT}"

# Normal integral by its power series: pdf(z) * sum of z^(2k+1) / (2k+1)!!, which always has one sign.
_PDF = "(exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()))"
_CDF = (
    "(0.5 + sign({z}) * " + _PDF + " * list_sum(list_transform(range(90), lambda k: "
    "exp((2 * k + 1) * ln(greatest(abs({z}), 1e-300)) - lgamma(k + 1.5) - (k + 1) * ln(2) + 0.5 * ln(pi())))))"
)

# A saturated probit has the normal quantiles of the shares as linear predictors: Newton on the integral.
_PRIORITY_TERMS = tuple(
    ("(Intercept)" if i == 0 else f"priority{level}", level) for i, level in enumerate(b.PRIORITIES)
)
PROBIT_ONE_FACTOR = f"""
WITH RECURSIVE design AS (SELECT *, 1 + o_custkey % 7 AS w, o_custkey % 20 AS psu FROM orders),
shares AS (
  SELECT o_orderpriority AS p_level, sum(w * CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) / CAST(sum(w) AS DOUBLE) AS p
  FROM design GROUP BY 1
),
newton AS (
  SELECT 0 AS step, p_level, p, CAST(0 AS DOUBLE) AS z FROM shares
  UNION ALL
  SELECT step + 1, p_level, p, z - ({_CDF.format(z="z")} - p) / {_PDF.format(z="z")} FROM newton WHERE step < 8
),
quantiles AS (SELECT p_level, z FROM newton WHERE step = 8),
{_factor_fit(
    "o_orderpriority", _PRIORITY_TERMS, "design", "o_orderpriority", "CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END",
    ("(SELECT z FROM quantiles WHERE p_level = level)",
     "(SELECT exp(-z * z / 2) / sqrt(2 * pi()) FROM quantiles WHERE p_level = level)"),
)}
SELECT term, round(estimate, 6) AS estimate, round(se, 6) AS std_error FROM fit"""


def _line_probit(x: str, y: str, table: str, weight: str, stratum: str, psu: str) -> str:
    """Probit of one number by Newton's method on two parameters, over the distinct values of the number."""
    return f"""
probit_rows AS (SELECT {x} AS x, {y} AS y, {weight} AS w, {stratum} AS h, {psu} AS psu FROM {table}),
cells AS (
  SELECT x, CAST(sum(w) AS DOUBLE) AS w, CAST(sum(w * y) AS DOUBLE) AS wy FROM probit_rows GROUP BY x
),
newton AS (
  SELECT 0 AS step, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b,
    CAST(0 AS DOUBLE) AS i00, CAST(0 AS DOUBLE) AS i01, CAST(0 AS DOUBLE) AS i11
  UNION ALL
  SELECT step + 1, a + (i11 * s0 - i01 * s1) / (i00 * i11 - i01 * i01), b + (i00 * s1 - i01 * s0) / (i00 * i11 - i01 * i01),
    i00, i01, i11
  FROM (
    SELECT step, a, b, sum(f) AS i00, sum(f * x) AS i01, sum(f * x * x) AS i11, sum(s) AS s0, sum(s * x) AS s1
    FROM (
      SELECT step, a, b, x, d * (wy - w * p) / (p * (1 - p)) AS s, w * d * d / (p * (1 - p)) AS f FROM (
        SELECT step, a, b, x, w, wy, {_CDF.format(z="(a + b * x)")} AS p, {_PDF.format(z="(a + b * x)")} AS d
        FROM newton, cells WHERE step < 12
      )
    ) GROUP BY step, a, b
  )
),
probit AS (SELECT * FROM newton WHERE step = 12),
fitted AS (
  SELECT x AS fx, a + b * x AS z, {_CDF.format(z="(a + b * x)")} AS p, {_PDF.format(z="(a + b * x)")} AS d,
    i00, i01, i11, i00 * i11 - i01 * i01 AS det, a, b FROM cells, probit
),
probit_scores AS (
  SELECT h, psu, w * d * (y - p) / (p * (1 - p)) AS s, x, a, b, i00, i01, i11, det FROM probit_rows JOIN fitted ON fx = x
),
probit_parts AS (
  SELECT '(Intercept)' AS term, a AS estimate, h, psu, (i11 * s - i01 * s * x) / det AS u FROM probit_scores
  UNION ALL SELECT 'x', b, h, psu, (i00 * s * x - i01 * s) / det FROM probit_scores
),
probit_clusters AS (
  SELECT term, any_value(estimate) AS estimate, h, psu, sum(u) AS z FROM probit_parts GROUP BY term, h, psu
),
probit_strata AS (
  SELECT term, any_value(estimate) AS estimate, h, count(*) * var_samp(z) AS v FROM probit_clusters GROUP BY term, h
),
probit_fit AS (SELECT term, any_value(estimate) AS estimate, sqrt(sum(v)) AS se FROM probit_strata GROUP BY term)"""



PROBIT_STEPS = 8


def _orthogonal(order: list[int], weight: str, prefix: str, source: str, carried: str) -> tuple[list[str], str]:
    """CTEs that make the columns c<i> orthogonal one after another under a weight; the last is complete."""
    steps = []
    for place, i in enumerate(order):
        parts = "".join(
            f" - sum({weight} * c{i} * {prefix}{j}) OVER () / sum({weight} * {prefix}{j} * {prefix}{j}) OVER () * {prefix}{j}"
            for j in order[:place]
        )
        name = f"{carried}_{place}"
        steps.append(f"{name} AS (SELECT *, c{i}{parts} AS {prefix}{i} FROM {source})")
        source = name
    return steps, source


def _probit(terms: dict[str, str], y: str, source: str, design: tuple[str, str, str]) -> str:
    """Probit by repeated least squares over the distinct covariate values, unrolled; linearised errors.

    Each step projects the working response on the terms through an orthogonal basis, so no step needs
    the coefficients; those follow once at the end.
    """
    n, (weight, stratum, psu) = len(terms), design
    names = ", ".join(f"c{i}" for i in range(n))
    out = [
        f"q AS (SELECT *, {weight} AS pw, {stratum} AS ph, {psu} AS pc, {y} AS py, "
        + ", ".join(f"CAST({e} AS DOUBLE) AS c{i}" for i, e in enumerate(terms.values()))
        + f" FROM {source})",
        f"k0 AS (SELECT {names}, CAST(sum(pw) AS DOUBLE) AS sw, sum(pw * py) / CAST(sum(pw) AS DOUBLE) AS ybar,"
        f" CAST(0 AS DOUBLE) AS eta FROM q GROUP BY {names})",
    ]

    def working(table: str, name: str) -> list[str]:
        return [
            f"{name}p AS (SELECT {names}, sw, ybar, eta, {_CDF.format(z='eta')} AS p, {_PDF.format(z='eta')} AS d FROM {table})",
            f"{name}w AS (SELECT *, sw * d * d / (p * (1 - p)) AS ww, eta + (ybar - p) / d AS zz FROM {name}p)",
        ]

    table = "k0"
    for step in range(1, PROBIT_STEPS + 1):
        out += working(table, f"k{step}")
        chain, last = _orthogonal(list(range(n)), "ww", "u", f"k{step}w", f"k{step}u")
        out += chain
        projected = " + ".join(f"sum(ww * zz * u{i}) OVER () / sum(ww * u{i} * u{i}) OVER () * u{i}" for i in range(n))
        table = f"k{step}"
        out.append(f"{table} AS (SELECT {names}, sw, ybar, {projected} AS eta FROM {last})")
    out += working(table, "f")
    table = "fw"
    for k in range(n):
        chain, last = _orthogonal([i for i in range(n) if i != k] + [k], "ww", f"r{k}_", table, f"f{k}")
        out += chain
        drop = ", ".join(f"r{k}_{i}" for i in range(n) if i != k)
        out.append(
            f"g{k} AS (SELECT * EXCLUDE ({drop}), sum(ww * r{k}_{k} * eta) OVER () / sum(ww * r{k}_{k} * r{k}_{k}) OVER () AS b{k},"
            f" sum(ww * r{k}_{k} * r{k}_{k}) OVER () AS a{k} FROM {last})"
        )
        table = f"g{k}"
    same = " AND ".join(f"q.c{i} = {table}.c{i}" for i in range(n))
    parts = " UNION ALL ".join(
        f"SELECT '{t}' AS term, b{k} AS estimate, ph, pc, pw * d * (py - p) / (p * (1 - p)) * r{k}_{k} / a{k} AS u"
        f" FROM q JOIN {table} ON {same}"
        for k, t in enumerate(terms)
    )
    out += [
        f"probit_parts AS ({parts})",
        "probit_terms AS (SELECT term, any_value(estimate) AS estimate FROM probit_parts GROUP BY term)",
        # Clusters of the whole design count, also those without a complete row.
        f"all_clusters AS (SELECT DISTINCT {stratum} AS ph, {psu} AS pc FROM {source.split(' WHERE ')[0]})",
        "probit_clusters AS (SELECT term, any_value(estimate) AS estimate, ph, pc, sum(u) AS z FROM"
        " (SELECT * FROM probit_parts UNION ALL SELECT term, estimate, ph, pc, 0 FROM probit_terms, all_clusters)"
        " GROUP BY term, ph, pc)",
        "probit_strata AS (SELECT term, any_value(estimate) AS estimate, ph, CASE WHEN count(*) > 1 THEN count(*) * var_samp(z)"
        " ELSE 0 END AS v FROM probit_clusters GROUP BY term, ph)",
        "probit_fit AS (SELECT term, any_value(estimate) AS estimate, sqrt(sum(v)) AS se FROM probit_strata GROUP BY term)",
        f"probit_cells AS (SELECT {names}, p, d FROM {table})",
    ]
    return ",\n".join(out)


_SHOW_PROBIT = """
SELECT term, round(estimate, 5) AS estimate, round(se, 5) AS std_error, round(estimate / se, 5) AS statistic FROM probit_fit"""
_LEFT = "CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END"
_PRIORITY_DUMMIES = {"(Intercept)": "1"} | {
    f"priority{p}": f"CASE WHEN o_orderpriority = '{p}' THEN 1 ELSE 0 END" for p in b.PRIORITIES[1:]
}
PROBIT_FIT = f"""
WITH {_probit(_PRIORITY_DUMMIES | {"log_price": "ln(o_totalprice)"}, _LEFT, "orders",
    ("1 + o_custkey % 7", "o_orderpriority", "o_custkey % 20"))}
{_SHOW_PROBIT}"""

PROBIT_POPULATIONS = "\nUNION ALL\n".join(
    f"""SELECT '{name}' AS model, term, estimate, std_error, TRUE AS converged FROM (
WITH {_probit(_PRIORITY_DUMMIES | {"step": "floor(o_totalprice / 50000)"}, _LEFT, f"orders WHERE {where}",
    ("1 + o_custkey % 7", "o_orderpriority", "o_custkey % 20"))}
{_SHOW_PROBIT})"""
    for name, where in (("all", "true"), ("cheap", "o_totalprice < 150000"), ("odd", "o_custkey % 2 = 1"))
)

_GROUP_DUMMIES = {
    "(Intercept)": "1",
    "groupMACHINERY": "CASE WHEN \"group\" = 'MACHINERY' THEN 1 ELSE 0 END",
    "groupHOME": "CASE WHEN \"group\" = 'HOME' THEN 1 ELSE 0 END",
    "balance": "balance / 1000",
}
EVASION_PROBIT = f"""
WITH {COVARIATES}, evasion AS ({EVASION}),
people AS (SELECT * FROM evasion JOIN covariates USING (o_custkey)),
{_probit(_GROUP_DUMMIES, "evaded", 'people WHERE "group" IS NOT NULL', ("1 + o_custkey % 7", "o_custkey % 3", "o_custkey % 20"))}
{_SHOW_PROBIT}"""

_SELECTION_TERMS = {k: v for k, v in _MINCER_TERMS.items() if not k.startswith(("status", "quantity"))} | {"tax": "l_tax"}
HECKMAN_TWO_STEP = f"""
WITH {DESIGN},
{_probit(_SELECTION_TERMS, "CASE WHEN l_discount > 0 THEN 1 ELSE 0 END", "design", ("w", "l_linenumber", "psu"))},
chosen AS (
  SELECT q.* EXCLUDE (c0, c1, c2, c3), d / p AS mills
  FROM q JOIN probit_cells x ON q.c0 = x.c0 AND q.c1 = x.c1 AND q.c2 = x.c2 AND q.c3 = x.c3 WHERE l_discount > 0
),
{_several_terms(_MINCER_TERMS | {"quantity2": "l_quantity * l_quantity", "mills": "mills"}, _LOG_PRICE, "chosen")}
SELECT 'selection' AS model, term, round(estimate, 5) AS estimate, round(se, 5) AS std_error FROM probit_fit
UNION ALL SELECT 'outcome', term, round(estimate, 5), round(se, 5) FROM fit"""

PROBIT_ONE_NUMBER = f"""
WITH RECURSIVE {_line_probit(
    "CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) + month(o_orderdate) / CAST(12 AS DOUBLE)",
    "CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END", "orders", "1 + o_custkey % 7", "o_orderpriority", "o_custkey % 20")}
SELECT replace(term, 'x', 'season') AS term, round(estimate, 6) AS estimate, round(se, 6) AS std_error FROM probit_fit"""

_TWO_STEP_TERMS = _MINCER_TERMS | {"quantity2": "l_quantity * l_quantity", "mills": "mills"}
HECKMAN_ONE_NUMBER = f"""
WITH RECURSIVE {DESIGN.strip()},
{_line_probit("l_tax", "CASE WHEN l_discount > 0 THEN 1 ELSE 0 END", "design", "w", "l_linenumber", "psu")},
chosen AS (SELECT design.*, d / p AS mills FROM design JOIN fitted ON fx = l_tax WHERE l_discount > 0),
{_several_terms(_TWO_STEP_TERMS, _LOG_PRICE, "chosen")}
SELECT 'selection' AS model, replace(term, 'x', 'tax') AS term, round(estimate, 5) AS estimate, round(se, 5) AS std_error
FROM probit_fit
UNION ALL SELECT 'outcome', term, round(estimate, 5), round(se, 5) FROM fit"""

_HASHED = ", ".join(f"CAST({k} AS VARCHAR)" for k in b.ROW_KEYS)
RESIDUAL_IMPUTE = f"""
WITH {DESIGN},
{_several_terms(_MINCER_TERMS, _LOG_PRICE, "design WHERE l_quantity >= 25", ROW_KEYS + ",")},
donors AS (SELECT e AS residual, row_number() OVER (ORDER BY md5(concat_ws('|', {_HASHED})), e) - 1 AS position FROM e),
model AS (SELECT count(*) AS n, {", ".join(f"any_value(b{k}) AS b{k}" for k in range(5))} FROM e),
targets AS (
  SELECT {ROW_KEYS}, l_returnflag, l_linestatus, l_quantity,
    CAST(floor(CAST('0x' || substr(md5(concat_ws('|', {_HASHED}, '7')), 1, 13) AS BIGINT) / CAST(16 AS DOUBLE) ** 13
      * (SELECT n FROM model)) AS BIGINT) AS position
  FROM design WHERE l_quantity < 25
),
imputed AS (
  SELECT {", ".join("targets." + k for k in b.ROW_KEYS)}, residual,
    b0 + CASE l_returnflag WHEN 'N' THEN b1 WHEN 'R' THEN b2 ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN b3 ELSE 0 END
      + b4 * l_quantity + residual AS imputed
  FROM targets JOIN donors USING (position), model
)
SELECT {ROW_KEYS}, round(residual, 6) AS drawn_residual, round(imputed, 6) AS log_imputed, round(exp(imputed), 2) AS imputed
FROM imputed"""

NORMAL_FUNCTIONS = f"""
WITH placed AS (SELECT {ROW_KEYS}, l_quantity, (l_quantity - 25) / CAST(6 AS DOUBLE) AS z FROM lineitem)
SELECT {ROW_KEYS}, l_quantity, round({_CDF.format(z="z")}, 9) AS cdf, round({_PDF.format(z="z")}, 9) AS pdf FROM placed"""

TEXT_COLUMNS = """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
  CAST(o_orderdate AS VARCHAR) AS o_orderdate, substr(o_orderpriority, 3) AS priority
FROM orders"""

MILLS_RATIO = f"""
WITH predicted AS (
  SELECT {ROW_KEYS}, CASE WHEN l_linenumber <> 4 THEN
    -2.6 + CASE l_returnflag WHEN 'N' THEN 0.7 WHEN 'R' THEN -1.1 ELSE 0 END + l_quantity * CAST(0.07 AS DOUBLE) END AS z
  FROM lineitem
)
SELECT {ROW_KEYS}, round(z, 8) AS z, round({_PDF.format(z="z")} / {_CDF.format(z="z")}, 8) AS mills FROM predicted"""

# --- Cox regression of several terms --------------------------------------------------------------

COX_STEPS = 7


def _cox(terms: dict[str, str], source: str) -> str:
    """Newton's method for the Efron likelihood, unrolled.

    For every tied event the people at risk are rows with their risk shares as weights. Then the
    information is the weighted cross-product of the centred terms, and the score that of the terms with
    "is the event" over the share, so a Newton step is a least squares fit.
    """
    n = len(terms)
    names = ", ".join(f"c{i}" for i in range(n))
    out = [
        "cox_people AS (SELECT time, status, " + ", ".join(f"CAST({e} AS DOUBLE) AS c{i}" for i, e in enumerate(terms.values()))
        + f" FROM {source})",
        "cox_events AS (SELECT time AS t, count(*) AS d FROM cox_people WHERE status = 1 GROUP BY time)",
        f"cox_rows AS (SELECT t, l / CAST(d AS DOUBLE) AS part, d, CASE WHEN time = t AND status = 1 THEN 1 ELSE 0 END AS e, {names}"
        " FROM cox_people JOIN (SELECT t, d, unnest(range(d)) AS l FROM cox_events) ON time >= t)",
        "cox0 AS (SELECT " + ", ".join(f"CAST(0 AS DOUBLE) AS b{i}" for i in range(n)) + ")",
    ]

    def step(before: str, name: str) -> str:
        """Adds the CTEs of one step at the coefficients of `before`; returns the last, with z<k> for each term."""
        eta = " + ".join(f"b{i} * c{i}" for i in range(n))
        centred = ", ".join(f"c{i} - sum(p * c{i}) OVER (PARTITION BY t, part) AS c{i}" for i in range(n))
        out.extend(
            [
                f"{name}r AS (SELECT t, part, e, d, {names}, exp({eta}) * (1 - part * e) AS r FROM cox_rows, {before})",
                f"{name}p AS (SELECT *, r / sum(r) OVER (PARTITION BY t, part) AS p FROM {name}r)",
                f"{name}c AS (SELECT p, e / CAST(d AS DOUBLE) / p AS y, {centred} FROM {name}p)",
            ]
        )
        last = f"{name}c"
        for k in range(n):
            chain, last = _orthogonal([i for i in range(n) if i != k] + [k], "p", f"z{k}_", last, f"{name}o{k}")
            out.extend(chain)
        return last

    for number in range(1, COX_STEPS + 1):
        last = step(f"cox{number - 1}", f"s{number}")
        moved = ", ".join(
            f"any_value(b{k}) + sum(p * z{k}_{k} * y) / sum(p * z{k}_{k} * z{k}_{k}) AS b{k}" for k in range(n)
        )
        out.append(f"cox{number} AS (SELECT {moved} FROM {last}, cox{number - 1})")
    last = step(f"cox{COX_STEPS}", "sf")
    out.append(
        "cox_fit AS ("
        + " UNION ALL ".join(
            f"SELECT '{t}' AS term, any_value(b{k}) AS estimate, 1 / sqrt(sum(p * z{k}_{k} * z{k}_{k})) AS se"
            f" FROM {last}, cox{COX_STEPS}"
            for k, t in enumerate(terms)
        )
        + ")"
    )
    return ",\n".join(out)


_SEGMENT_DUMMIES = {f"segment{v}": f"CASE WHEN segment = '{v}' THEN 1 ELSE 0 END" for v in b.SEGMENTS[1:]}
COX_FIT = f"""
WITH {SURVIVAL}, {COVARIATES}, people AS (SELECT * FROM survival JOIN covariates USING (o_custkey)),
{_cox(_SEGMENT_DUMMIES | {"balance": "balance / 1000"}, "people")}
SELECT term, round(estimate, 5) AS estimate, round(se, 5) AS std_error, round(estimate / se, 5) AS statistic FROM cox_fit"""

# --- a study on the survey view --------------------------------------------------------------------

_STUDY_PARTS = (("total", "count", ""), ("total_by", "course", "'Regular do ensino médio'"), ("share", "grade", "grade"))
_GONE = "gone AND age <= 24 AND pc <= 660"
_STUDY_DESIGN = f"""
{PANEL},
design AS (
  SELECT x.wave, CAST(1 + x.o_custkey % 7 AS DOUBLE) AS w, x.o_custkey % 6 AS h, x.o_custkey % 48 AS psu,
    CASE CAST(substr(x.o_orderpriority, 1, 1) AS INTEGER) % 4
      WHEN 0 THEN 'Primeira (o)' WHEN 1 THEN 'Segunda (o)' WHEN 2 THEN 'Terceira (o)' END AS grade,
    14 + x.o_custkey % 13 AS age, (c_acctbal + 1000) / 8 * CAST(1.02 AS DOUBLE) AS pc,
    x.o_custkey % 9 = 0 AS alone, x.o_custkey % 4 <> 0 AS started,
    x.o_orderstatus = 'F' AS attending, x.o_orderstatus = 'F' AND coalesce(y.o_orderstatus = 'P', false) AS gone
  FROM latest x JOIN customer ON c_custkey = x.o_custkey
    LEFT JOIN latest y ON y.o_custkey = x.o_custkey AND y.wave = x.wave + 1
  WHERE x.wave < 7 AND x.o_custkey % 11 <> 0 AND x.o_custkey % 50 <> 0
)"""
_STUDY_DOMAINS = {
    "first_visit": "true", "attending": "attending", "dropout": "gone",
    "dropout_target": f"{_GONE} AND NOT alone", "dropout_potential": f"{_GONE} AND started",
}
DROPOUT_STUDY = f"""
WITH {_STUDY_DESIGN}
{_points(_STUDY_PARTS, _STUDY_DOMAINS, by="wave")}"""


def _study_errors() -> str:
    """Linearised errors: cluster totals of every row's score, wave by wave, over all clusters of the wave."""
    items = [("total", "count", "NULL", "1", "1"), ("total_by", "course", "'Regular do ensino médio'", "1", "1")]
    for level in ("Primeira (o)", "Segunda (o)", "Terceira (o)"):
        items.append(("share", "grade", f"'{level}'", "CASE WHEN grade IS NOT NULL THEN 1 ELSE 0 END", f"CASE WHEN grade = '{level}' THEN 1 ELSE 0 END"))
    long = " UNION ALL ".join(
        f"SELECT wave, h, psu, w, '{name}' AS subpop, '{stat}' AS stat, '{var}' AS var, CAST({level} AS VARCHAR) AS level, "
        f"CASE WHEN {inside} THEN {x} ELSE 0 END AS x, CASE WHEN {inside} THEN {y} ELSE 0 END AS y FROM design"
        for name, inside in _STUDY_DOMAINS.items()
        for stat, var, level, x, y in items
    )
    keys = "wave, subpop, stat, var, level"
    same = " AND ".join(f"p.{k} IS NOT DISTINCT FROM l.{k}" for k in keys.split(", "))
    return f"""
WITH {_STUDY_DESIGN}, long AS ({long}),
points AS (
  SELECT {keys}, CASE WHEN stat = 'share' THEN sum(w * y) / sum(w * x) ELSE sum(w * y) END AS value,
    CASE WHEN stat = 'share' THEN sum(w * x) ELSE 1 END AS bottom
  FROM long GROUP BY {keys} HAVING sum(w * y) > 0
),
clusters AS (
  SELECT l.wave, l.subpop, l.stat, l.var, l.level, h, psu, any_value(p.value) AS value,
    sum(l.w * CASE WHEN l.stat = 'share' THEN (l.y - p.value * l.x) / p.bottom ELSE l.y END) AS z
  FROM long l JOIN points p ON {same} GROUP BY l.wave, l.subpop, l.stat, l.var, l.level, h, psu
),
strata AS (SELECT {keys}, h, any_value(value) AS value, count(*) * coalesce(var_samp(z), 0) AS v FROM clusters GROUP BY {keys}, h)
SELECT {keys}, round(any_value(value), 4) AS value, round(sqrt(sum(v)), 4) AS std_error FROM strata GROUP BY {keys}"""


_TRAITS = {
    "V2007": "CASE WHEN l_partkey % 2 = 0 THEN 'Mulher' ELSE 'Homem' END",
    "V2010": "['Branca', 'Preta', 'Amarela', 'Parda', 'Indígena', 'Ignorado'][1 + l_suppkey % 6]",
    "V1022": "CASE WHEN l_suppkey % 3 = 0 THEN 'Rural' ELSE 'Urbana' END",
    "VD2004": "CASE WHEN l_suppkey % 9 = 0 THEN 'Unipessoal' ELSE 'Nuclear' END",
    "V4003": "CASE WHEN l_tax = 0 THEN 'Não' ELSE 'Sim' END",
    "S010311": "CASE WHEN l_partkey % 2 = 0 THEN 'Sim' ELSE 'Não' END",
    "S01028": "CASE WHEN l_partkey % 3 = 0 THEN 'Sim' ELSE 'Não' END",
    "S01024": "CASE WHEN l_partkey % 5 = 0 THEN 'Sim' ELSE 'Não' END",
    "S01002": "concat('Parede ', l_partkey % 3)",
    "S01003": "concat('Telhado ', l_partkey % 4)",
    "S01004": "concat('Piso ', l_partkey % 2)",
    "S01007": "concat('Água ', l_suppkey % 3)",
    "S01010": "concat('Cano ', l_suppkey % 2)",
    "S01017": "concat('Domicílio ', l_suppkey % 3)",
    "region": "['Norte', 'Nordeste', 'Sudeste', 'Sul', 'Centro-Oeste', NULL][1 + l_orderkey % 6]",
}
_ATTENDS = {
    "V3002": "CASE l_returnflag WHEN 'A' THEN 'Sim' WHEN 'N' THEN 'Não' END",
    "V3003A": "CASE WHEN l_partkey % 3 = 0 THEN 'Superior' WHEN l_returnflag <> 'R' THEN 'Regular do ensino médio' END",
    "V3002A": "CASE WHEN l_suppkey % 5 = 0 THEN 'Rede privada' WHEN l_returnflag <> 'R' THEN 'Rede pública' END",
}


def _characterisation() -> str:
    """Household income and schooling, then one plain aggregate per sub-population and statistic."""
    member, work, other = "l_linenumber <> 7", "CASE WHEN l_quantity > 5 THEN l_extendedprice / 50 END", "CASE WHEN l_discount <> 0 THEN l_extendedprice * l_discount / 50 END"
    parent = "arg_min(1 + l_partkey % 5, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey) FILTER (l_linenumber IN (1, 2, 6) AND l_partkey % 2 = {})"
    traits = ", ".join(f"{value} AS {name}" for name, value in (_TRAITS | _ATTENDS).items())
    parts = [("total", "count", ""), *[("share", name, name) for name in _TRAITS], ("mean", "income_pc", "pc"), ("mean", "parent_max", "parent_max")]
    joined = {"attendance_course": ("V3002", "V3003A"), "attendance_course_network": ("V3002", "V3003A", "V3002A")}
    parts += [("share", name, " || '.' || ".join(columns)) for name, columns in joined.items()]
    in_course = "V3003A = 'Regular do ensino médio' AND V3002A = 'Rede pública'"
    domains = {
        "target": f"young AND {in_course} AND poor AND VD2004 <> 'Unipessoal'",
        "potential": "(young AND poor AND l_partkey % 4 = 0) OR l_partkey % 4 = 1",
        "public_school": "V3002A = 'Rede pública'",
    }
    levels = {"V3002": ("Sim", "Não"), "V3003A": ("Superior", "Regular do ensino médio"), "V3002A": ("Rede privada", "Rede pública")}
    empty = " UNION ALL ".join(
        f"SELECT DISTINCT year, subpop, stat, var, '{'.'.join(combined)}' AS level FROM found WHERE var = '{name}'"
        for name, columns in joined.items()
        for combined in product(*[levels[c] for c in columns])
    )
    return f"""
WITH people AS (SELECT *, [2018, 2019, 2022, 2023][1 + year(l_shipdate) % 4] AS year FROM lineitem),
households AS (
  SELECT year, l_orderkey, count(*) FILTER ({member}) AS members,
    coalesce(sum({work} * CAST(1.02 AS DOUBLE)) FILTER ({member}), 0) + coalesce(sum({other} * CAST(1.03 AS DOUBLE)) FILTER ({member}), 0) AS income,
    greatest({parent.format(0)}, {parent.format(1)}) AS parent_max
  FROM people GROUP BY year, l_orderkey
),
valued AS (
  SELECT *, 1 + l_quantity / 10 AS w, CASE WHEN {member} THEN income / nullif(members, 0) END AS pc,
    CAST(l_quantity AS INTEGER) BETWEEN 14 AND 24 AS young, {traits}
  FROM people JOIN households USING (year, l_orderkey)
),
design AS (
  SELECT *, coalesce(pc <= 660, false) OR l_discount >= 0.09 OR l_tax > 0.075 AS poor FROM valued
),
found AS ({_points(parts, domains, by="year", digits=4)})
SELECT * FROM found
UNION ALL SELECT e.*, 0 FROM ({empty}) e ANTI JOIN found USING (year, subpop, stat, var, level)"""


# --- reports -------------------------------------------------------------------------------------

_LABELS = {"target": "target_group", "potential": "potential_group", "public": "public_school"}


def _wide(value: str) -> str:
    return ", ".join(f"max(CASE WHEN subpop = '{k}' THEN {value} END) AS {v}" for k, v in _LABELS.items())


def _percent(value: str, digits: int = 2) -> str:
    return f"regexp_replace(printf('%.{digits}f', round_even({value} * 100, {digits})), '\\.0+$|(\\.[0-9]*[1-9])0+$', '\\1') || '%'"


REPORT_TOTALS = f"""
WITH {DESIGN}, e AS ({_points([("total", "count", "")], by="year", digits=4)})
SELECT var AS category, year, {_wide("value")} FROM e GROUP BY var, year"""

_BLOCK_PARTS = (("share", "flag", FLAG), ("share", "status", STATUS), ("mean", "price", PRICE))
REPORT_BLOCKS = f"""
WITH {DESIGN}, e AS ({_points(_BLOCK_PARTS, by="year", digits=12)}),
shown AS (
  SELECT subpop, CASE var WHEN 'flag' THEN 1 WHEN 'status' THEN 2 ELSE 3 END AS block, coalesce(level, var) AS category,
    CASE WHEN stat = 'mean'
      THEN regexp_replace(printf('%.2f', round_even(value, 2)), '\\.0+$|(\\.[0-9]*[1-9])0+$', '\\1')
      ELSE {_percent("value")} END AS value
  FROM e WHERE year = 1997
),
wide AS (SELECT block, category, {_wide("value")} FROM shown GROUP BY block, category)
SELECT block, CAST(row_number() OVER (PARTITION BY block ORDER BY category) AS INTEGER) AS ord, category,
  target_group, potential_group, public_school FROM wide
UNION ALL SELECT * FROM (VALUES (1, 0, 'Flag', NULL, NULL, NULL), (2, 0, 'Status', NULL, NULL, NULL),
  (3, 0, 'Income', NULL, NULL, NULL))"""

REPORT_SHARES = f"""
WITH {DESIGN}, e AS ({_points(
    [("share", "flag_status", "l_returnflag || '.' || l_linestatus")], {"target": DOMAINS["target"]}, "year", 12)})
SELECT 1 AS block, CAST(row_number() OVER (ORDER BY level) AS INTEGER) AS ord, level AS category,
  {_percent("value")} AS target_group
FROM e WHERE year = 1997 AND value > 0
UNION ALL SELECT 1, 0, 'Flag and status', NULL"""

REPORT_HOUSEHOLD_TYPES = f"""
WITH {DESIGN}, e AS ({_points([("share", "line", LINE)], {"potential": DOMAINS["potential"]}, "year", 12)})
SELECT level AS category, {_percent("value")} AS potential_group FROM e WHERE year = 1997"""

REPORT_REGION = f"""
WITH s AS (
  SELECT r_name, r_regionkey, count(*) AS n
  FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
  WHERE s_acctbal > 0 GROUP BY ALL
), shares AS (SELECT *, n / CAST(sum(n) OVER () AS DOUBLE) AS value FROM s)
SELECT 'solvent' AS subpop, r_name AS category, round(value, 6) AS value, {_percent("value", 0)} AS label,
  CASE WHEN r_regionkey < 4 THEN r_regionkey END AS r_regionkey
FROM shares"""


def _cell(df_cuts: tuple[float, float, float]) -> str:
    # Two-sided Student t quantiles at .05, .01 and .001 for the design's degrees of freedom.
    low, middle, high = df_cuts
    t = "abs(estimate / se)"
    stars = f"CASE WHEN {t} > {high} THEN '***' WHEN {t} > {middle} THEN '**' WHEN {t} > {low} THEN '*' ELSE '' END"
    return f"printf('%.3f', round_even(estimate, 3)) || {stars} || ' (' || printf('%.3f', round_even(se, 3)) || ')'"


COEF_TABLE_WIDE = f"""
SELECT coalesce(f.term, n.term) AS term, f.cell AS factor, n.cell AS number FROM
(WITH {DESIGN}, {_FACTOR} SELECT term, {_cell((1.999624, 2.658857, 3.457294))} AS cell FROM fit) f
FULL JOIN
(WITH {DESIGN}, {_number_fit("true", None)} SELECT term, {_cell((1.998972, 2.657479, 3.454485))} AS cell FROM fit) n
ON f.term = n.term"""

ORACLES = {
    "household_income": _income(QUARTERLY, 4),
    "household_income_annual": _income(ANNUAL, 3),
    "parent_max": PARENT_MAX,
    "region_recode": REGION_RECODE,
    "category_recode": CATEGORY_RECODE,
    "person_key": PERSON_KEY,
    "audience_flags": AUDIENCE_FLAGS,
    "hourly_wage": HOURLY_WAGE,
    "deflator_join": DEFLATOR_JOIN,
    "label_decode": LABEL_DECODE,
    "quarterly_waves": QUARTERLY_WAVES,
    "annual_files": ANNUAL_FILES,
    "fixed_width_read": FIXED_WIDTH_READ,
    "baseline_cohort": BASELINE_COHORT,
    "pair_dropout": f"WITH {PAIRS} SELECT o_custkey, wave FROM gone",
    "dropout_semi": f"WITH {PAIRS} SELECT o_orderkey, o_custkey, wave, o_orderstatus FROM panel SEMI JOIN gone USING (o_custkey, wave)",
    "attrition_anti": f"""WITH {PANEL} SELECT o_custkey FROM latest WHERE wave = 1 AND o_orderstatus = 'F'
        AND o_custkey NOT IN (SELECT o_custkey FROM latest WHERE wave = 2)""",
    "survival_table": f"WITH {SURVIVAL} SELECT * FROM survival",
    "raw_quarters": f"WITH {RAW} SELECT * EXCLUDE (problem) FROM raw WHERE problem IS NULL",
    "raw_quarter_counts": f"WITH {RAW} SELECT year, quarter, problem, count(*) AS n FROM raw GROUP BY ALL",
    "monthly_survival": MONTHLY_SURVIVAL,
    "monthly_dropout": MONTHLY_DROPOUT,
    "matched_waves": MATCHED_WAVES,
    "evasion_flag": EVASION,
    "cohort_covariates": f"WITH {SURVIVAL}, {COVARIATES} SELECT * FROM survival JOIN covariates USING (o_custkey)",
    "svy_total": f"WITH {DESIGN} {_points([('total', 'count', '')])}",
    "svy_total_by": f"WITH {DESIGN} {_points([('total_by', 'status', STATUS)])}",
    "svy_share": f"WITH {DESIGN} {_points([('share', 'flag', FLAG), ('share', 'status', STATUS)])}",
    "svy_mean": f"WITH {DESIGN} {_points([('mean', 'price', PRICE)], digits=4)}",
    "svy_interaction": SVY_INTERACTION,
    "svy_batch": f"WITH {DESIGN} {_points(BATCH_PARTS, by='year', digits=4)}",
    "svy_poststratify": f"""WITH {POSTSTRATIFIED} {_points(
        [('total', 'count', ''), ('total_by', 'flag', FLAG), ('share', 'status', STATUS)],
        {'all': 'true', **DOMAINS}, digits=4)}""",
    "svy_se_taylor": SVY_SE_TAYLOR,
    "svy_se_poststratified": SVY_SE_POSTSTRATIFIED,
    "svy_se_replicate": _replicate_sql(),
    "svy_se_bootstrap": SVY_SE_BOOTSTRAP,
    "km_curve": KM_CURVE,
    "km_curve_by": KM_CURVE_BY,
    "cox_one_binary": COX_ONE_BINARY,
    "cox_fit": COX_FIT,
    "wls_one_factor": WLS_ONE_FACTOR,
    "wls_one_number": WLS_ONE_NUMBER,
    "wls_sandwich_se": WLS_SANDWICH_SE,
    "wls_many_levels": WLS_MANY_LEVELS,
    "wls_significance": WLS_SIGNIFICANCE,
    "mincer_fit": MINCER_FIT,
    "probit_one_factor": PROBIT_ONE_FACTOR,
    "probit_fit": PROBIT_FIT,
    "probit_populations": PROBIT_POPULATIONS,
    "evasion_probit": EVASION_PROBIT,
    "heckman_two_step": HECKMAN_TWO_STEP,
    "probit_one_number": PROBIT_ONE_NUMBER,
    "heckman_one_number": HECKMAN_ONE_NUMBER,
    "mills_ratio": MILLS_RATIO,
    "dropout_study_se": _study_errors(),
    "characterisation_study": _characterisation(),
    "normal_functions": NORMAL_FUNCTIONS,
    "text_columns": TEXT_COLUMNS,
    "region_names": "SELECT r_regionkey, r_name AS category FROM region",
    "coef_roundtrip": WLS_ONE_NUMBER,
    "residual_impute": RESIDUAL_IMPUTE,
    "dropout_study": DROPOUT_STUDY,
    "report_totals": REPORT_TOTALS,
    "report_blocks": REPORT_BLOCKS,
    "report_shares": REPORT_SHARES,
    "report_household_types": REPORT_HOUSEHOLD_TYPES,
    "report_region": REPORT_REGION,
    "coef_table_wide": COEF_TABLE_WIDE,
    "landed_estimates": f"WITH {DESIGN} {_points(BATCH_PARTS, by='year', digits=4)}",
    "estimates_roundtrip": f"WITH {DESIGN} {_points([('share', 'flag', FLAG)], by='year')}",
}
