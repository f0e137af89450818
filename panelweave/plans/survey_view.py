"""The given tables dressed as the household survey, so that the studies run on them as written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.operators.panel import wave_states
from panelweave.plans import bindings as b

# Order and customer keys fall into 48 clusters, eight in each of six strata.
_PLACE = """
  CAST({key} AS STRING) AS V1008, '1' AS V1014,
  concat(1 + {key} % 6, lpad({key} % 48, 3, '0')) AS UPA,
  {key} % 6 AS stratum
"""

_ANNUAL = f"""
  {_PLACE.format(key="l_orderkey")},
  element_at(array(2018, 2019, 2022, 2023), CAST(1 + year(l_shipdate) % 4 AS INT)) AS year,
  1 + l_quantity / 10 AS weight,
  '1' AS V1016,
  CASE WHEN l_suppkey % 3 = 0 THEN 'Rural' ELSE 'Urbana' END AS V1022,
  l_linenumber AS V2001,
  l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS V2003,
  element_at(array('Responsável', 'Cônjuge', 'Filho(a)', 'Filho(a)', 'Filho(a)', 'Pai ou mãe', 'Pensionista'),
    l_linenumber) AS V2005,
  CASE WHEN l_partkey % 2 = 0 THEN 'Mulher' ELSE 'Homem' END AS V2007,
  CASE WHEN l_partkey % 2 = 0 THEN 2 ELSE 1 END AS V2007_code,
  day(l_shipdate) AS V2008, month(l_shipdate) AS V20081,
  CASE WHEN l_tax = 0 THEN 9999 ELSE year(l_shipdate) END AS V20082,
  CAST(l_quantity AS INT) AS V2009,
  element_at(array('Branca', 'Preta', 'Amarela', 'Parda', 'Indígena', 'Ignorado'), CAST(1 + l_suppkey % 6 AS INT)) AS V2010,
  CAST(l_linenumber AS STRING) AS VD2002, l_linenumber AS VD2002_code,
  CASE WHEN l_suppkey % 9 = 0 THEN 'Unipessoal' ELSE 'Nuclear' END AS VD2004,
  element_at(array('Fundamental completo ou equivalente', 'Médio incompleto ou equivalente', 'Superior', NULL),
    CAST(1 + l_partkey % 4 AS INT)) AS VD3004,
  concat(l_partkey % 5, ' anos') AS VD3005, CAST(1 + l_partkey % 5 AS INT) AS VD3005_code,
  CASE l_returnflag WHEN 'A' THEN 'Sim' WHEN 'N' THEN 'Não' END AS V3002,
  CASE WHEN l_suppkey % 5 = 0 THEN 'Rede privada' WHEN l_returnflag <> 'R' THEN 'Rede pública' END AS V3002A,
  CASE WHEN l_partkey % 3 = 0 THEN 'Superior' WHEN l_returnflag <> 'R' THEN 'Regular do ensino médio' END AS V3003A,
  element_at(array('Primeira (o)', 'Segunda (o)', 'Terceira (o)', NULL), CAST(1 + l_suppkey % 4 AS INT)) AS V3006,
  CASE WHEN l_quantity <= 5 THEN NULL ELSE l_extendedprice / 50 END AS VD4019,
  CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice * l_discount / 50 END AS VD4048,
  1 + l_tax AS CO1, 1 + l_tax / 2 AS CO1e, 1.02D AS CO2, 1.03D AS CO2e,
  CASE WHEN l_tax = 0 THEN NULL ELSE l_extendedprice / 10 END AS VD4017,
  6 * l_linenumber AS V4039,
  CASE WHEN l_tax = 0 THEN NULL WHEN l_suppkey % 7 = 0
    THEN 'Empregado no setor público (inclusive servidor estatutário e militar)' ELSE 'Setor privado' END AS VD4008,
  CASE WHEN l_tax = 0 THEN 'Não' ELSE 'Sim' END AS V4003,
  CASE WHEN l_discount >= 0.09 THEN 'Sim' WHEN l_discount > 0 THEN 'Não' END AS V5001A,
  CASE WHEN l_tax > 0.075 THEN 'Sim' ELSE 'Não' END AS V5002A, CAST(NULL AS STRING) AS V5003A,
  CASE WHEN l_partkey % 2 = 0 THEN 'Sim' ELSE 'Não' END AS S010311,
  CASE WHEN l_partkey % 3 = 0 THEN 'Sim' ELSE 'Não' END AS S01028,
  CASE WHEN l_partkey % 5 = 0 THEN 'Sim' ELSE 'Não' END AS S01024,
  concat('Parede ', l_partkey % 3) AS S01002, concat('Telhado ', l_partkey % 4) AS S01003,
  concat('Piso ', l_partkey % 2) AS S01004, concat('Água ', l_suppkey % 3) AS S01007,
  concat('Cano ', l_suppkey % 2) AS S01010, concat('Domicílio ', l_suppkey % 3) AS S01017
"""

_WAVE = f"""
  {_PLACE.format(key="o_custkey")},
  wave, 1 + o_custkey % 7 AS weight,
  CASE WHEN o_custkey % 11 = 0 THEN '2' ELSE '1' END AS V1016,
  CASE WHEN c_nationkey % 3 = 0 THEN 'Rural' ELSE 'Urbana' END AS V1022,
  1 + o_custkey % 5 AS V2001, 1 AS V2003, 'Responsável' AS V2005,
  CASE WHEN c_nationkey % 2 = 0 THEN 'Mulher' ELSE 'Homem' END AS V2007,
  CASE WHEN c_nationkey % 2 = 0 THEN 2 ELSE 1 END AS V2007_code,
  1 AS V2008, 1 AS V20081, CASE WHEN o_custkey % 50 = 0 THEN 9999 ELSE 2007 END AS V20082,
  CAST(14 + o_custkey % 13 AS INT) AS V2009,
  element_at(array('Branca', 'Preta', 'Amarela', 'Parda', 'Indígena', 'Ignorado'), 1 + c_nationkey % 6) AS V2010,
  '1' AS VD2002, 1 AS VD2002_code,
  CASE WHEN o_custkey % 9 = 0 THEN 'Unipessoal' ELSE 'Nuclear' END AS VD2004,
  CASE WHEN o_custkey % 4 = 0 THEN 'Superior' ELSE 'Médio incompleto ou equivalente' END AS VD3004,
  concat(c_nationkey % 5, ' anos') AS VD3005, 1 + c_nationkey % 5 AS VD3005_code,
  CASE status WHEN 0 THEN 'Sim' WHEN 1 THEN 'Não' END AS V3002,
  'Rede pública' AS V3002A, 'Regular do ensino médio' AS V3003A,
  element_at(array('Primeira (o)', 'Segunda (o)', 'Terceira (o)', NULL), 1 + grade) AS V3006,
  (c_acctbal + 1000) / 8 AS VD4020, 1.02D AS Efetivo
"""


def annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as people, orders as households."""
    return b.table(spark, sf_dir, "lineitem").selectExpr(*_columns(_ANNUAL))


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as people seen once in each wave in which they ordered; the last order of a wave counts."""
    status = F.expr("CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END")
    grade = F.expr("CAST(substring(o_orderpriority, 1, 1) AS INT) % 4")
    wide = wave_states(
        b.panel(spark, sf_dir),
        "o_custkey",
        "wave",
        {f"w{w}": (w, status * 10 + grade) for w in b.WAVES},
        order=b.PANEL_ORDER,
    )
    long = wide.unpivot(["o_custkey"], [f"w{w}" for w in b.WAVES], "name", "state").where("state IS NOT NULL")
    people = long.selectExpr(
        "o_custkey", "CAST(substring(name, 2) AS INT) AS wave", "state DIV 10 AS status", "CAST(state % 10 AS INT) AS grade"
    )
    customers = b.table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return people.join(customers, "o_custkey").selectExpr(*_columns(_WAVE))


def _columns(text: str) -> list[str]:
    """Split a select list at the commas outside parentheses."""
    out, depth, start = [], 0, 0
    for i, char in enumerate(text):
        depth += (char == "(") - (char == ")")
        if char == "," and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]
