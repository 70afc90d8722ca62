"""Shared SQL fragments for the comparison queries."""

from __future__ import annotations

import re

BAR = """arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close,
  sum(qty) AS vol, sum(amt) AS amount"""


def change(src: str) -> str:
    return f"""SELECT *, (close / pre_close - 1) * 100 AS pct_chg FROM (
  SELECT *, lag(close) OVER (PARTITION BY code ORDER BY dt) AS pre_close,
    row_number() OVER (PARTITION BY code ORDER BY dt) AS i FROM {src})"""


CTES: dict[str, str] = {
    "ticks": """SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS dt, l_extendedprice / l_quantity AS px,
  l_quantity AS qty, l_extendedprice AS amt,
  {'o': l_orderkey, 'n': l_linenumber, 'p': l_partkey} AS k FROM lineitem""",
    "members": """SELECT s_suppkey AS code, s_name AS name, CAST(r_regionkey AS BIGINT) AS l1, r_name AS l1_name,
  CAST(n_nationkey AS BIGINT) AS l2, n_name AS l2_name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "bars": f"SELECT code, dt, {BAR} FROM ticks GROUP BY code, dt",
    "panel": change("bars"),
    "l2bars": f"""SELECT l2 AS code, l2_name AS name, l1 AS parent, l1_name AS parent_name, dt, {BAR}
  FROM ticks JOIN members USING (code) GROUP BY l2, l2_name, l1, l1_name, dt""",
    "l2panel": change("l2bars"),
    "l1bars": f"""SELECT l1 AS code, l1_name AS name, dt, {BAR}
  FROM ticks JOIN members USING (code) GROUP BY l1, l1_name, dt""",
    "l1panel": change("l1bars"),
    "weekbars": f"""SELECT l2 AS code, CAST(date_trunc('week', dt) AS DATE) AS dt, {BAR}
  FROM ticks JOIN members USING (code) GROUP BY l2, CAST(date_trunc('week', dt) AS DATE)""",
    "weekpanel": change("weekbars"),
    "moneyflow": """SELECT *, buy_elg_amount - sell_elg_amount AS net_mf_amount FROM (
  SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS dt,
    sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0.0 END) AS buy_elg_amount,
    sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice ELSE 0.0 END) AS sell_elg_amount
  FROM lineitem GROUP BY ALL)""",
    "margin": """SELECT *, sum(rzmre - rzche) OVER (PARTITION BY code ORDER BY dt ROWS UNBOUNDED PRECEDING) AS rzye FROM (
  SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS dt,
    sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice ELSE 0.0 END) AS rzmre,
    sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0.0 END) AS rzche
  FROM lineitem GROUP BY ALL)""",
    "valuation": """SELECT l_suppkey AS code, CAST(date_trunc('month', l_shipdate) AS DATE) AS dt,
  avg(l_extendedprice / l_quantity) / nullif(avg(l_discount) * 1000, 0.0) AS pe_ttm,
  avg(l_extendedprice / l_quantity) / 1000 AS pb, avg(l_tax) * 100 AS roe, avg(l_discount) * 100 AS gross_margin,
  avg(l_quantity) / 5 AS ar_turn, sum(l_extendedprice) AS total_mv
  FROM lineitem GROUP BY ALL""",
    "statements": """SELECT *, cfo - capex AS fcf, '1' AS report_type FROM (
  SELECT l_suppkey AS code, make_date(year(l_shipdate), 12, 31) AS end_date, sum(l_extendedprice) AS revenue,
    sum(l_extendedprice * (l_discount - l_tax)) AS n_income, sum(l_extendedprice * l_discount) AS cfo,
    sum(l_extendedprice * l_tax) AS capex,
    sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0.0 END) AS receivables
  FROM lineitem GROUP BY ALL)""",
    "scores": """SELECT code, dt, close, vol, amount, i,
  ((code * 7919 + datediff('day', DATE '1995-01-01', dt) * 104729) % 1000) / 1000.0::DOUBLE AS p_momentum,
  ((code * 6007 + datediff('day', DATE '1995-01-01', dt) * 15487) % 1000) / 1000.0::DOUBLE AS p_reversion,
  ((code * 3571 + datediff('day', DATE '1995-01-01', dt) * 86028) % 1000) / 1000.0::DOUBLE AS p_breakout,
  (lead(close, 1) OVER (PARTITION BY code ORDER BY dt) / close - 1) * 100 AS t1_ret,
  (lead(close, 5) OVER (PARTITION BY code ORDER BY dt) / close - 1) * 100 AS d5_ret,
  (lead(close, 20) OVER (PARTITION BY code ORDER BY dt) / close - 1) * 100 AS fwd_ret
  FROM panel""",
    "calendar": "SELECT dt, row_number() OVER (ORDER BY dt) AS date_idx FROM (SELECT DISTINCT dt FROM ticks)",
}


def whole(expr: str, unit: str = "1e6", over: str = "") -> str:
    """Sum in whole ``1 / unit``: the same in whatever order rows are added."""
    return f"(sum(CAST(floor(({expr}) * {unit} + 0.5) AS BIGINT)) {over})::DOUBLE / {unit}"


def mean(expr: str) -> str:
    return f"({whole(expr, '1e9')} / count({expr}))"


_BUY, _SELL, _A, _R = (f"CASE WHEN {k} = '{v}' THEN l_extendedprice ELSE 0.0 END" for k, v in (("l_linestatus", "O"), ("l_linestatus", "F"), ("l_returnflag", "A"), ("l_returnflag", "R")))

# The same panels with sums that do not depend on the order of the rows, for queries that rank or divide by them.
EXACT: dict[str, str] = {
    "bars": f"SELECT code, dt, {BAR.replace('sum(amt)', whole('amt', '1e4'))} FROM ticks GROUP BY code, dt",
    "moneyflow": f"""SELECT *, buy_elg_amount - sell_elg_amount AS net_mf_amount FROM (
  SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS dt, {whole(_BUY)} AS buy_elg_amount, {whole(_SELL)} AS sell_elg_amount
  FROM lineitem GROUP BY ALL)""",
    "margin": f"""SELECT *, {whole('rzmre - rzche', over='OVER (PARTITION BY code ORDER BY dt ROWS UNBOUNDED PRECEDING)')} AS rzye FROM (
  SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS dt, {whole(_A)} AS rzmre, {whole(_R)} AS rzche
  FROM lineitem GROUP BY ALL)""",
    "valuation": f"""SELECT l_suppkey AS code, CAST(date_trunc('month', l_shipdate) AS DATE) AS dt,
  {mean('l_extendedprice / l_quantity')} / nullif({mean('l_discount')} * 1000, 0.0) AS pe_ttm,
  {mean('l_extendedprice / l_quantity')} / 1000 AS pb, {mean('l_tax')} * 100 AS roe, {mean('l_discount')} * 100 AS gross_margin,
  {mean('l_quantity')} / 5 AS ar_turn, {whole('l_extendedprice')} AS total_mv
  FROM lineitem GROUP BY ALL""",
    "statements": f"""SELECT *, cfo - capex AS fcf, '1' AS report_type FROM (
  SELECT l_suppkey AS code, make_date(year(l_shipdate), 12, 31) AS end_date, {whole('l_extendedprice')} AS revenue,
    {whole('l_extendedprice * (l_discount - l_tax)')} AS n_income, {whole('l_extendedprice * l_discount')} AS cfo,
    {whole('l_extendedprice * l_tax')} AS capex, {whole(_BUY)} AS receivables
  FROM lineitem GROUP BY ALL)""",
}


def cte(name: str, sql: str) -> None:
    """Register a further shared fragment."""
    CTES[name] = sql


def with_ctes(body: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """Prefix ``body`` with every fragment it (transitively) names."""
    pool = {**CTES, **(extra or {})}
    needed: list[str] = []

    def visit(text: str, me: str | None = None) -> None:
        for name in pool:
            if name != me and name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(pool[name], name)
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{n} AS ({pool[n]})" for n in needed) + "\n" + body


def r(expr: str, digits: int = 4) -> str:
    """Rounded value without a negative zero; exact halves are nudged upwards."""
    return f"(round(({expr})::DOUBLE + 1e-{digits + 4}, {digits}) + 0.0)"


def over(n: int, part: str = "code", order: str = "dt") -> str:
    return f"OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


W = "OVER (PARTITION BY code ORDER BY dt)"


def rolled(fn: str, x: str, n: int, min_rows: int = 1) -> str:
    value = f"{fn}({x}) {over(n)}"
    return value if min_rows <= 1 else f"CASE WHEN count({x}) {over(n)} >= {min_rows} THEN {value} END"
