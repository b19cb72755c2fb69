"""The registered queries as SQL over the raw driver tables."""

from __future__ import annotations

from textwrap import dedent

AVERAGES = (5, 10, 20, 30, 60)


def _bars(session: str, name: str) -> str:
    order = "ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity"
    back = "ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC, l_quantity DESC"
    return f"""{name} AS (
      SELECT symbol, bar_date,
        max(CASE WHEN f = 1 THEN px END) AS open, max(px) AS high, min(px) AS low,
        max(CASE WHEN b = 1 THEN px END) AS close, CAST(sum(qty) AS DECIMAL(18,2)) AS vol
      FROM (
        SELECT l_suppkey AS symbol, {session} AS bar_date,
          CAST(l_extendedprice AS DECIMAL(18,2)) AS px, CAST(l_quantity AS DECIMAL(18,2)) AS qty,
          row_number() OVER (PARTITION BY l_suppkey, {session} {order}) AS f,
          row_number() OVER (PARTITION BY l_suppkey, {session} {back}) AS b
        FROM lineitem)
      GROUP BY symbol, bar_date)"""


WEEK = "CAST(date_trunc('week', l_shipdate) AS DATE)"
BARS_W = _bars(WEEK, "bars")
BARS_D = _bars("CAST(l_shipdate AS DATE)", "days")

CALENDAR = f"""calendar AS (
      SELECT bar_date, row_number() OVER (ORDER BY bar_date) - 1 AS sess
      FROM (SELECT DISTINCT {WEEK} AS bar_date FROM lineitem))"""

MASTER = """master AS (
      SELECT s_suppkey AS symbol, s_name AS name, n_name AS area, r_name AS industry
      FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
      WHERE NOT coalesce(s_acctbal < 0, false))"""
LISTED = "symbol IN (SELECT symbol FROM master)"

SHARES = "CAST(100 + (symbol % 5) * 20 AS DOUBLE)"
ISSUED = "CAST(2 + symbol % 3 AS DOUBLE)"
EPS = "CAST(1000 + (symbol % 20) * 50 AS DOUBLE)"
METRICS = f"""CAST(close AS DOUBLE) / {EPS} AS pe, CAST(close AS DOUBLE) / ({EPS} + 200) AS pe_ttm,
        {SHARES} AS float_share, {SHARES} * {ISSUED} AS total_share,
        CAST(close AS DOUBLE) * {SHARES} * {ISSUED} / 10000 AS total_mv,
        CAST(close AS DOUBLE) * {SHARES} / 10000 AS circ_mv,
        100.0::DOUBLE * CAST(vol AS DOUBLE) / {SHARES} AS tor"""

CHANGE = "100.0::DOUBLE * (CAST(close AS DOUBLE) - CAST(pre_close AS DOUBLE)) / nullif(CAST(pre_close AS DOUBLE), 0)"

QUOTED = f"""quoted AS (
      SELECT *, {CHANGE} AS pct_chg, {METRICS}
      FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY bar_date) AS pre_close FROM bars))"""


def _sum(n: int, price: str = "close") -> str:
    frame = f"(PARTITION BY symbol ORDER BY bar_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(*) OVER {frame} = {n} THEN sum({price}) OVER {frame} END"


def _ma(n: int, price: str = "close") -> str:
    return f"CAST({_sum(n, price)} AS DOUBLE) / {n}::DOUBLE"


# The adjustment factor of a bar; averages are compared on prices times factor.
_RATE = "CAST(1 + (year(bar_date) - 1995) / 10.0 AS DECIMAL(10,2))"

# The panel through five equality joins on (symbol, session - k).
_PAST = "\n".join(f"      JOIN s b{k} ON b{k}.symbol = s.symbol AND b{k}.sess = s.sess - {k}" for k in range(1, 6))
_WIDE = ", ".join(f"b{k}.{c} AS {c}_b{k}" for c in ("tor", "high", "low") for k in range(1, 6))
PANEL = f"""s AS (
      SELECT q.*, sess, {", ".join(f"{_sum(n, 'px')} AS sum{n}" for n in AVERAGES)}
      FROM (SELECT *, close * {_RATE} AS px, low * {_RATE} AS low_px FROM quoted) q JOIN calendar USING (bar_date)),
    panel AS (
      SELECT s.*, {_WIDE}, b1.pct_chg AS pct_b1, b2.pct_chg AS pct_b2, n1.pct_chg AS pct_n1
      FROM s
{_PAST}
      LEFT JOIN s n1 ON n1.symbol = s.symbol AND n1.sess = s.sess + 1)"""

_SESSIONS = "s AS (SELECT q.*, sess FROM quoted q JOIN calendar USING (bar_date))"

LATEST = f"""latest AS (
      SELECT symbol, name, area, industry, bar_date, open, high, low, close, {METRICS}
      FROM master LEFT JOIN (
        SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_date DESC) = 1) USING (symbol))"""


def _d(*names: str) -> str:
    return ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names)


def _with(*ctes: str) -> str:
    return "WITH " + ",\n    ".join(ctes) + "\n    "


_REPORT = f"""symbol, name, area, industry, CAST(close AS DOUBLE) AS close_adj, {_d("close")}, bar_date,
      pct_chg, pct_n1, pe, pe_ttm"""


def _screen(where: str) -> str:
    return f"{_with(BARS_W, CALENDAR, MASTER, QUOTED, PANEL)}SELECT {_REPORT} FROM panel JOIN master USING (symbol) WHERE {where}"


# Conditions of the seven panel screens.
SCREENS = {
    "steady_turnover": (
        "tor BETWEEN 15 AND 60 AND tor_b1 BETWEEN 15 AND 60 AND tor_b2 BETWEEN 15 AND 60 AND tor_b3 BETWEEN 15 AND 60"
        " AND pe BETWEEN 10 AND 80 AND close BETWEEN 5000 AND 80000"
    ),
    "valley_turnover": (
        "tor >= tor_b1 AND tor_b1 <= tor_b2 AND tor_b2 <= tor_b3 AND tor_b3 <= tor_b4 AND tor >= 20 AND tor_b1 >= 5"
        " AND close BETWEEN 5000 AND 90000 AND pe BETWEEN 5 AND 90 AND pe_ttm >= 5"
        " AND px * 20 >= sum20 AND px * 60 >= sum60"
    ),
    "v_shape": (
        "high <= high_b1 AND high_b1 <= high_b2 AND high_b2 <= high_b3 AND pct_chg > -90 AND pct_chg < 300"
        " AND low <= high_b1 AND tor >= 10 AND tor_b1 >= 10 AND px * 20 >= sum20"
    ),
    "rising_lows": (
        "low >= low_b1 AND low_b1 >= low_b2 AND low_b2 >= low_b3 AND pct_chg <= 400 AND pct_b1 <= 400"
        " AND pct_b2 <= 400 AND close BETWEEN 5000 AND 100000 AND pe >= 5 AND pe_ttm >= 5 AND px * 5 >= sum5"
    ),
    "doji": (
        "open <= close AND abs(CAST(open AS DOUBLE) - CAST(close AS DOUBLE)) / CAST(open AS DOUBLE) <= 0.05"
        " AND pct_chg BETWEEN -50 AND 400 AND pct_n1 BETWEEN -90 AND 500 AND regexp_matches(area, 'NATION_1|NATION_2')"
        " AND tor >= 10 AND tor_b1 >= 5 AND pe BETWEEN 5 AND 90 AND pe_ttm >= 5"
    ),
    "cross_all_averages": "close BETWEEN 55000 AND 104000 AND pe BETWEEN 38 AND 90 AND pe_ttm >= 34 AND tor >= 20 AND "
    + " AND ".join(f"px * {n} > sum{n} AND low_px * {n} < sum{n}" for n in AVERAGES),
    "turnover_surge": (
        "close >= 5000 AND ((tor_b1 = 0 AND tor > 0) OR tor / nullif(tor_b1, 0) >= 3) AND px * 5 >= sum5"
    ),
}

INDICATORS = """indicators AS (
      SELECT l_suppkey AS symbol, CAST(quarter + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS report_end,
        CAST(count(*) AS DOUBLE) / 10.0::DOUBLE AS eps,
        CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / 100.0::DOUBLE AS capital_rese_ps
      FROM (SELECT *, date_trunc('quarter', l_shipdate) AS quarter FROM lineitem)
      GROUP BY l_suppkey, quarter)"""

LEDGER = """ledger AS (
      SELECT year(o_orderdate) AS sheet_year, o_orderpriority AS business, CAST(o_orderkey AS VARCHAR) AS contract_no,
        CASE WHEN o_orderkey % 89 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%y/%m/%d') END AS trade_date,
        CASE WHEN o_orderstatus = 'P' THEN '' ELSE c_mktsegment END AS security,
        CASE WHEN o_orderkey % 97 = 0 THEN '--'
          WHEN o_orderpriority = '2-HIGH' OR (o_orderpriority IN ('3-MEDIUM', '5-LOW') AND o_orderstatus = 'O')
          THEN CAST(-px AS VARCHAR) ELSE CAST(px AS VARCHAR) END AS amount,
        CAST(CAST(px * 0.001 AS DECIMAL(20,6)) AS VARCHAR) AS fee,
        CAST(CAST(px * 0.001 AS DECIMAL(20,6)) AS VARCHAR) AS stamp_duty,
        CAST(CAST(px * 0.0002 AS DECIMAL(20,6)) AS VARCHAR) AS transfer_fee
      FROM (SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS px FROM orders)
      JOIN customer ON o_custkey = c_custkey),
    clean AS (
      SELECT security, business, contract_no,
        CAST(try_strptime(trade_date, '%y/%m/%d') AS DATE) AS trade_date,
        TRY_CAST(amount AS DECIMAL(38,10)) AS amount, TRY_CAST(fee AS DECIMAL(38,10)) AS fee,
        TRY_CAST(stamp_duty AS DECIMAL(38,10)) AS stamp_duty, TRY_CAST(transfer_fee AS DECIMAL(38,10)) AS transfer_fee
      FROM ledger WHERE NOT regexp_matches(business, 'NOT SPECIFIED')),
    profit AS (
      SELECT security, round(coalesce(sum(amount), 0), 2) AS profit
      FROM clean WHERE security IS NOT NULL GROUP BY security
      HAVING security <> (SELECT min(security) FROM clean))"""

LINK = r"""<li><a href="(.*?)">(.*?)</a></li>"""
LINKS = f"""links AS (
      SELECT page_id, unnest(range(len(hrefs))) AS pos, unnest(hrefs) AS href, unnest(titles) AS title
      FROM (SELECT page_id, regexp_extract_all(html, '{LINK}', 1) AS hrefs,
              regexp_extract_all(html, '{LINK}', 2) AS titles FROM pages))"""
TITLE_WORD = "CASE WHEN regexp_matches(html, '<title>([^ <]+)') THEN regexp_extract(html, '<title>([^ <]+)', 1) END"
# The pages at addresses of their own, with links to the pages around them in four forms.
_START = '<li><a href="'
SITE = f"""site AS (
      SELECT page_id, array_to_string(list_transform(string_split(html, '{_START}'), lambda x, i: CASE WHEN i = 1 THEN x
        ELSE '{_START}' || ['https://pages.example/pages/', '//pages.example/pages/', '/pages/', ''][(i - 2) % 4 + 1]
          || CAST(page_id + (i - 1) * 3 - 8 AS VARCHAR) || regexp_replace(x, '^[^"]*', '') END), '') AS html FROM pages)"""


def _followed(name: str, regex: str, title: bool = True) -> str:
    """Links of a kind with the page that they name, whatever the form of the address."""
    titles = f"regexp_extract_all(html, '{regex}', 2)" if title else "NULL"
    return f"""{name} AS (
      SELECT l.page_id, pos, href, title, t.page_id AS target_id
      FROM (SELECT page_id, unnest(range(len(hrefs))) AS pos, unnest(hrefs) AS href, unnest(titles) AS title
            FROM (SELECT page_id, regexp_extract_all(html, '{regex}', 1) AS hrefs, {titles} AS titles FROM site)) l
      JOIN pages t ON regexp_extract(href, '[^/]*$') = CAST(t.page_id AS VARCHAR))"""


_BODY = "(?s)</script>(.*?)<footer>"
BODY = f"CASE WHEN regexp_matches(html, '{_BODY}') THEN regexp_extract(html, '{_BODY}', 1) END"
_RECORD = r'(?s)<html lang="(.*?)">.*?<title>(.*?)</title>.*?<h1>(.*?)</h1>.*?&copy; (.*?) &middot; (.*?)</footer>'
RECORD_FIELDS = ("lang", "title", "heading", "host", "note")
RECORDS = (
    "records AS (SELECT page_id, "
    + ", ".join(f"unnest(regexp_extract_all(html, '{_RECORD}', {i})) AS {n}" for i, n in enumerate(RECORD_FIELDS, 1))
    + f", unnest(range(len(regexp_extract_all(html, '{_RECORD}', 1)))) AS pos FROM pages)"
)
# Non-ASCII characters of European text that GBK can hold; all others turn into '?'.
GBK_LOSS = "[^\\x00-\\x7F¤§¨°±·×àáèéêìíòó÷ùúü]"


def _gbk(col: str) -> str:
    return f"regexp_replace({col}, '{GBK_LOSS}', '?', 'g')"


def _weekly_rising() -> str:
    lags = ", ".join(
        f"lag({c}, {k}) OVER (PARTITION BY symbol ORDER BY bar_date) AS {c}{k}"
        for c in ("high", "close", "open", "low")
        for k in (1, 2)
    )
    test = " AND ".join(f"{c} >= {c}1 AND {c}1 >= {c}2" for c in ("high", "close", "open", "low"))
    return (
        f"rising AS (SELECT * FROM (SELECT *, {lags}, row_number() OVER (PARTITION BY symbol ORDER BY bar_date DESC)"
        f" AS age FROM bars) WHERE {test})"
    )


_OHLC = _d("open", "high", "low", "close")
_FACTOR = "CAST(CAST(1 + (year(bar_date) - 1995) / 10.0 AS DECIMAL(10,2)) AS DOUBLE)"
_LAST_FACTOR = f"""last_value({_FACTOR}) OVER (PARTITION BY symbol ORDER BY bar_date
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""


def _adjusted(source: str) -> str:
    prices = ", ".join(
        f"CAST({c} AS DOUBLE) * {_FACTOR} / {_LAST_FACTOR} AS {c}" for c in ("open", "high", "low", "close")
    )
    return f"adjusted AS (SELECT symbol, bar_date, {prices}, vol FROM {source})"


def _resampled(source: str, period: str, name: str) -> str:
    return f"""{name} AS (
      SELECT symbol, p AS bar_date, max(CASE WHEN f = 1 THEN open END) AS open, max(high) AS high, min(low) AS low,
        max(CASE WHEN b = 1 THEN close END) AS close, sum(vol) AS vol
      FROM (SELECT *, CAST(date_trunc('{period}', bar_date) AS DATE) AS p,
              row_number() OVER (PARTITION BY symbol, date_trunc('{period}', bar_date) ORDER BY bar_date) AS f,
              row_number() OVER (PARTITION BY symbol, date_trunc('{period}', bar_date) ORDER BY bar_date DESC) AS b
            FROM {source})
      GROUP BY symbol, p)"""


_PRE = "lag(close) OVER (PARTITION BY symbol ORDER BY bar_date) AS pre_close"
_DAY = "DATE '1997-11-17'"
_MA_COLUMNS = ", ".join(f"{_ma(n)} AS ma{n}" for n in AVERAGES)
_SCALED = f"""scaled AS (SELECT *, {_FACTOR} AS factor,
        close * {_RATE} AS px FROM bars)"""

_MA_ADJUSTED = ", ".join(f"{_ma(n, 'px')} / factor AS ma{n}" for n in AVERAGES)
_LATEST_MA = f"""SELECT symbol, bar_date, {_d("close", "low")}, {", ".join(f"ma{n}" for n in AVERAGES)}
      FROM (SELECT *, {_MA_ADJUSTED}, row_number() OVER (PARTITION BY symbol ORDER BY bar_date DESC) AS age FROM scaled)
      WHERE age = 1 AND {LISTED}"""

_PANEL_COLUMNS = f"""symbol, bar_date, sess, {_d("open", "high", "low", "close", "pre_close")}, tor, pct_chg,
      {", ".join(f"tor_b{k}" for k in range(1, 6))},
      {_d(*[f"{c}_b{k}" for c in ("high", "low") for k in range(1, 6)])}, pct_b1, pct_b2, pct_n1"""

_QUOTE = f"name, industry, area, bar_date, {_d('close')}, pe, pe_ttm"

DAILY_SCREENS = _with(BARS_W, CALENDAR, MASTER, QUOTED, PANEL) + " UNION ALL ".join(
    f"SELECT '{name}' AS screen, {_REPORT}, row_number() OVER (ORDER BY pct_n1 DESC NULLS LAST, symbol) AS rank FROM panel JOIN master USING (symbol) WHERE bar_date = {_DAY} AND {where}"
    for name, where in SCREENS.items()
)

SQL: dict[str, str] = {
    "scan_master": f"""{_with(MASTER)}SELECT symbol, name, area, industry FROM master
      JOIN supplier ON s_suppkey = symbol WHERE NOT (s_acctbal < 0)""",
    "scan_snapshot": f"""{_with(BARS_W)}SELECT symbol, bar_date, {_OHLC}, pe, pe_ttm, tor, total_mv
      FROM (SELECT *, CAST(close AS DOUBLE) / {EPS} AS pe, CAST(close AS DOUBLE) / ({EPS} + 200) AS pe_ttm,
        CAST(close AS DOUBLE) * {SHARES} * {ISSUED} AS total_mv,
        100.0::DOUBLE * CAST(vol AS DOUBLE) / {SHARES} AS tor FROM bars) WHERE bar_date = {_DAY}""",
    "bars_range": f"""{_with(BARS_W)}SELECT symbol, bar_date, {_OHLC}, {_d("vol")} FROM bars
      WHERE bar_date BETWEEN DATE '1995-06-05' AND DATE '1998-12-28'""",
    "limit_symbols": f"""{_with(MASTER)}SELECT symbol, name, area, industry FROM master
      JOIN supplier ON s_suppkey = symbol WHERE NOT (s_acctbal < 0) ORDER BY symbol LIMIT 4""",
    "bars_weekly": f"""{_with(BARS_W)}SELECT symbol, bar_date, {_OHLC}, {_d("vol")} FROM bars""",
    "bars_monthly": f"""{_with(BARS_D, _resampled("days", "month", "months"))}
      SELECT symbol, bar_date, {_OHLC}, {_d("vol", "pre_close")}, {CHANGE} AS pct_chg
      FROM (SELECT *, {_PRE} FROM months)""",
    "bars_pct_change": f"""{_with(BARS_W)}SELECT symbol, bar_date, {_d("close", "pre_close")}, {CHANGE} AS pct_chg
      FROM (SELECT *, {_PRE} FROM bars)""",
    "bars_qfq": f"{_with(BARS_W, _adjusted('bars'))}SELECT symbol, bar_date, open, high, low, close FROM adjusted",
    "bars_qfq_monthly": f"""{_with(BARS_D, _adjusted("days"), _resampled("adjusted", "month", "months"))}
      SELECT symbol, bar_date, open, high, low, close, {CHANGE} AS pct_chg FROM (SELECT *, {_PRE} FROM months)""",
    "moving_averages": f"""{_with(BARS_W)}SELECT symbol, bar_date, {_d("close")}, {_MA_COLUMNS} FROM bars""",
    "moving_averages_qfq": f"""{_with(BARS_W, _SCALED)}SELECT symbol, bar_date, {_d("close")},
      {_MA_ADJUSTED} FROM scaled""",
    "latest_ma": f"{_with(BARS_W, MASTER, _SCALED)}{_LATEST_MA}",
    "latest3_weekly": f"""{_with(BARS_D, _resampled("days", "week", "weeks"))}
      SELECT symbol, bar_date, {_OHLC}, age FROM (
        SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_date DESC) AS age FROM weeks) WHERE age <= 3""",
    "calendar_sessions": f"""{_with(CALENDAR)}SELECT bar_date, sess, strftime(bar_date, '%Y%m%d') AS t,
      {", ".join(f"strftime(lag(bar_date, {k}) OVER (ORDER BY sess), '%Y%m%d') AS t_b{k}" for k in range(1, 6))},
      strftime(lead(bar_date) OVER (ORDER BY sess), '%Y%m%d') AS t_n1,
      strftime(bar_date - INTERVAL 1 DAY, '%Y%m%d') AS day_before,
      strftime(bar_date + INTERVAL 1 DAY, '%Y%m%d') AS day_after FROM calendar""",
    "session_panel": f"{_with(BARS_W, CALENDAR, QUOTED, PANEL)}SELECT {_PANEL_COLUMNS} FROM panel",
    "session_returns": f"""{_with(BARS_W, CALENDAR, MASTER, QUOTED, _SESSIONS)}SELECT s.symbol, s.bar_date, s.sess, {_d("s.close").replace("AS s.close", "AS close")},
      s.pct_chg, b1.pct_chg AS pct_b1, b2.pct_chg AS pct_b2, n1.pct_chg AS pct_n1
      FROM s LEFT JOIN s b1 ON b1.symbol = s.symbol AND b1.sess = s.sess - 1 LEFT JOIN s b2 ON b2.symbol = s.symbol AND b2.sess = s.sess - 2
      LEFT JOIN s n1 ON n1.symbol = s.symbol AND n1.sess = s.sess + 1 WHERE s.{LISTED}""",
    "session_returns_day": f"""{_with(BARS_W, CALENDAR, MASTER, QUOTED, _SESSIONS)}, t AS (SELECT sess FROM calendar WHERE bar_date = {_DAY})
      SELECT m.*, {_DAY} AS bar_date, CAST(q.close AS DOUBLE) AS close, q.pe, q.pe_ttm, q.tor, q.pct_chg,
        b1.pct_chg AS pct_b1, b2.pct_chg AS pct_b2, n1.pct_chg AS pct_n1
      FROM master m CROSS JOIN t LEFT JOIN s q ON q.symbol = m.symbol AND q.sess = t.sess
      LEFT JOIN s b1 ON b1.symbol = m.symbol AND b1.sess = t.sess - 1 LEFT JOIN s b2 ON b2.symbol = m.symbol AND b2.sess = t.sess - 2
      LEFT JOIN s n1 ON n1.symbol = m.symbol AND n1.sess = t.sess + 1""",
    "ma_survivors": f"""{_with(BARS_W, MASTER, _SCALED)}SELECT * FROM ({_LATEST_MA}) WHERE symbol IN (
      SELECT symbol FROM bars WHERE bar_date = {_DAY} AND CAST(close AS DOUBLE) / {EPS} BETWEEN 10 AND 60)""",
    "rank_by_next_return": f"""{_with(BARS_W, CALENDAR, MASTER, QUOTED, PANEL)}SELECT symbol, bar_date, {_d("close")}, pct_n1,
      row_number() OVER (PARTITION BY bar_date ORDER BY pct_n1 DESC NULLS LAST, symbol) - 1 AS rank
      FROM panel WHERE {SCREENS["turnover_surge"]} AND {LISTED}""",
    "screen_steady_turnover": _screen(SCREENS["steady_turnover"]),
    "screen_valley_turnover": _screen(SCREENS["valley_turnover"]),
    "screen_v_shape": _screen(SCREENS["v_shape"]),
    "screen_rising_lows": _screen(SCREENS["rising_lows"]),
    "screen_doji": _screen(SCREENS["doji"]),
    "screen_cross_all_ma": _screen(SCREENS["cross_all_averages"]),
    "screen_turnover_surge": _screen(SCREENS["turnover_surge"]),
    "daily_screens": DAILY_SCREENS,
    "daily_screens_stored": DAILY_SCREENS,
    "screens_by_symbol": _with(BARS_W, CALENDAR, MASTER, QUOTED, PANEL)
    + " UNION ALL ".join(f"SELECT '{name}' AS screen, {_REPORT} FROM panel JOIN master USING (symbol) WHERE {where}" for name, where in SCREENS.items()),
    "screen_weekly_rising": f"{_with(BARS_W, MASTER, _weekly_rising())}SELECT symbol, bar_date, {_OHLC} FROM rising WHERE {LISTED}",
    "screen_weekly_rising_qfq": _with(BARS_D, MASTER, _adjusted("days"), _resampled("adjusted", "week", "bars"), _weekly_rising())
    + f"SELECT symbol, bar_date, {_OHLC} FROM rising WHERE {LISTED}",
    "screen_weekly_rising_now": f"""{_with(BARS_W, MASTER, _weekly_rising())}SELECT symbol, bar_date, {_OHLC}
      FROM rising WHERE age = 1 AND {LISTED}""",
    "screen_high_transfer": f"""{_with(BARS_W, MASTER, LATEST, INDICATORS)}SELECT symbol, name, {_d("close")},
      float_share, total_share, circ_mv, total_mv, report_end, capital_rese_ps, eps
      FROM latest JOIN indicators USING (symbol)
      WHERE close >= 9000 AND capital_rese_ps >= 6 AND eps >= 2.5
        AND total_share <= 500 AND float_share <= 150 AND total_mv <= 3000""",
    "screen_small_cap": f"""{_with(BARS_W, MASTER, QUOTED)}
      SELECT symbol, name, bar_date, {_d("close")}, pct_chg, pe, float_share, total_mv
      FROM master LEFT JOIN (SELECT * FROM quoted WHERE bar_date = {_DAY}) USING (symbol)
      WHERE float_share <= 160 AND total_mv <= 1500 AND close <= 45000 AND pe > 8 AND pe <= 35""",
    "snapshot_enrich": f"""{_with(BARS_W, MASTER)}SELECT symbol, name, area, industry, bar_date, {_OHLC}, pe, pe_ttm, tor
      FROM master LEFT JOIN (SELECT *, {METRICS} FROM bars WHERE bar_date = {_DAY}) USING (symbol)""",
    "fundamentals_join": f"""{_with(BARS_W, MASTER, LATEST, INDICATORS)}
      SELECT symbol, report_end, eps, capital_rese_ps, {_QUOTE} FROM indicators LEFT JOIN latest USING (symbol)
      WHERE report_end BETWEEN DATE '1995-03-31' AND DATE '2001-12-31'""",
    "fundamentals_latest": f"""{_with(BARS_W, MASTER, LATEST, INDICATORS)}
      SELECT symbol, report_end, eps, capital_rese_ps, {_QUOTE} FROM indicators LEFT JOIN latest USING (symbol)
      WHERE report_end BETWEEN DATE '1995-03-31' AND DATE '2001-12-31'""",
    "forecast_enrich": f"""{_with(BARS_W, MASTER, LATEST)}
      SELECT e.user_id AS symbol, CAST(ts AS DATE) AS ann_date, last_day(CAST(ts AS DATE)) AS end_date,
        event_type AS type, value - 50 AS p_change_min, value + 50 AS p_change_max, {_QUOTE}
      FROM events e LEFT JOIN latest ON latest.symbol = e.user_id
      WHERE event_type IN ('signup', 'purchase')
        AND CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-12-31'""",
    "ledger_union": f"""{_with(LEDGER)}SELECT CASE WHEN sheet_year < 1998 THEN 'early' ELSE 'late' END AS sheet,
      trade_date, nullif(security, '') AS security, business, amount, fee, CASE WHEN sheet_year < 1998 THEN transfer_fee END AS transfer_fee,
      contract_no FROM ledger""",
    "ledger_sheets": f"""{_with(LEDGER)}SELECT CAST(sheet_year AS VARCHAR) AS sheet,
      trade_date, nullif(security, '') AS security, business, amount, fee, CASE WHEN sheet_year < 1995 THEN transfer_fee END AS transfer_fee,
      contract_no FROM ledger""",
    "ledger_clean": f"""{_with(LEDGER)}SELECT CAST(NULL AS VARCHAR) AS currency, security, trade_date,
      CAST(NULL AS VARCHAR) AS price, CAST(NULL AS DOUBLE) AS quantity, {_d("amount")},
      CAST(NULL AS VARCHAR) AS cash_balance, CAST(NULL AS VARCHAR) AS remaining_quantity, contract_no, business,
      {_d("fee", "stamp_duty", "transfer_fee")}, CAST(NULL AS VARCHAR) AS settlement_fee,
      CAST(NULL AS VARCHAR) AS security_code, CAST(NULL AS VARCHAR) AS holder_code FROM clean""",
    "ledger_profit": f"""{_with(LEDGER)}SELECT security, {_d("profit")},
      row_number() OVER (ORDER BY profit DESC, security) - 1 AS rank FROM profit""",
    "ledger_cashflow": f"""{_with(LEDGER)}SELECT {_d("deposits", "withdrawals")}, {_d("fees", "stamp_duties", "transfer_fees")},
      row_count, column_count, CAST(deposits + withdrawals AS DOUBLE) AS net_inflow FROM (
        SELECT coalesce(sum(CASE WHEN business = '1-URGENT' THEN amount END), 0) AS deposits,
          coalesce(sum(CASE WHEN business = '2-HIGH' THEN amount END), 0) AS withdrawals,
          coalesce(sum(fee), 0) AS fees, coalesce(sum(stamp_duty), 0) AS stamp_duties,
          coalesce(sum(transfer_fee), 0) AS transfer_fees, count(*) AS row_count, CAST(16 AS BIGINT) AS column_count
        FROM clean)""",
    "ledger_cleared_profit": f"""{_with(LEDGER)}SELECT CAST(coalesce(sum(profit), 0) AS DOUBLE) AS cleared_profit
      FROM profit WHERE NOT regexp_matches(security, 'BUILDING|MACHINERY')""",
    "page_links": f"{_with(LINKS)}SELECT page_id, CAST(pos AS INTEGER) AS pos, href, title FROM links",
    "page_first_match": r"""SELECT page_id, CASE WHEN regexp_matches(html, '<li><a href="(.*?)">')
      THEN regexp_extract(html, '<li><a href="(.*?)">', 1) END AS href FROM pages""",
    "page_body": f"SELECT page_id, {BODY} AS body FROM pages",
    "page_records": f"{_with(RECORDS)}SELECT page_id, CAST(pos AS INTEGER) AS pos, {', '.join(RECORD_FIELDS)} FROM records",
    "page_link_follow": f"""{_with(SITE, _followed("links", LINK))}
      SELECT page_id, CAST(pos AS INTEGER) AS pos, href, title, target_id FROM links""",
    "page_chapters": f"""{_with(
        SITE,
        _followed("books", '<li><a href="(https://.*?)">(.*?)</a></li>'),
        _followed("onward", '<li><a href="(//.*?)">', title=False),
        _followed("chapters", '<li><a href="(/pages/.*?)">(.*?)</a></li>'),
    )}
      SELECT b.page_id AS list_id, CAST(b.pos AS INTEGER) AS book_pos, b.title AS book, b.target_id AS book_id,
        c.page_id AS chapters_id, CAST(c.pos AS INTEGER) AS chapter_pos, c.title AS chapter, c.target_id AS chapter_id,
        {BODY} AS text
      FROM books b JOIN onward f ON f.page_id = b.target_id AND f.pos = 0
      JOIN chapters c ON c.page_id = f.target_id JOIN site t ON t.page_id = c.target_id""",
    "page_offsets": r"""SELECT page_id, CAST(o AS INTEGER) AS "offset",
      regexp_replace(url, '[?#].*$', '') || '?offset=' || CAST(o AS VARCHAR) AS page_url
      FROM pages, unnest(range(0, 100, 10)) AS r(o)""",
    "pages_decode": f"SELECT page_id, {_gbk('html')} AS html FROM pages",
    "page_files_gbk": f"""SELECT page_id, {_gbk("regexp_replace(html, '[\\r\\n]', ' ', 'g')")}
      || CASE WHEN page_id % 3 = 0 THEN chr(65533) ELSE '' END AS html FROM pages""",
    "sink_roundtrip": f"{_with(BARS_W)}SELECT symbol, bar_date, {_OHLC}, {_d('vol')} FROM bars",
    "sink_dated_export": f"""{_with(BARS_W)}SELECT symbol, bar_date, {_d("close", "vol")}, bar_date AS report_date
      FROM bars WHERE bar_date IN ({_DAY}, CAST({_DAY} + INTERVAL 7 DAY AS DATE), CAST({_DAY} + INTERVAL 14 DAY AS DATE))""",
    "sink_csv_gbk": f"{_with(RECORDS)}SELECT page_id, {', '.join(f'{_gbk(n)} AS {n}' for n in RECORD_FIELDS)} FROM records",
    "film_records": f"""SELECT CAST(page_id AS VARCHAR) AS "Index", {_gbk(f"({TITLE_WORD})")} AS "Name",
      regexp_extract(html, '<html lang="([^"]*)"', 1) AS "Actor", CAST(page_id % 30 + 1990 AS VARCHAR) AS "Time",
      CAST(page_id % 10 AS VARCHAR) || '.' AS "Score", CAST(page_id % 7 AS VARCHAR) AS "Float"
      FROM pages WHERE regexp_matches(html, '<title>[^ <]')""",
    "sink_text_by_title": f"""SELECT {TITLE_WORD} AS title, unnest(string_split({BODY}, chr(10))) AS line FROM pages""",
    "sink_lines_by_title": f"""SELECT page_id, title, CAST(unnest(range(len(lines))) AS INTEGER) AS position, unnest(lines) AS line
      FROM (SELECT page_id, {TITLE_WORD} AS title, string_split({BODY}, chr(10)) AS lines FROM pages)""",
}
# The same records, whichever way their pages were found.
SQL["paged_listing"] = SQL["film_records"]
SQL = {name: dedent(text).strip() for name, text in SQL.items()}
