"""Logical schemas of the input tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


MASTER = "symbol string, name string, area string, industry string, list_status string, list_date date"

DAILY_METRIC = (
    "symbol string, bar_date date, close double, pe double, pe_ttm double, pb double, "
    "turnover_rate double, turnover_rate_f double, float_share double, total_share double, "
    "total_mv double, circ_mv double"
)

BARS = (
    "symbol string, bar_date date, open decimal(18,2), high decimal(18,2), low decimal(18,2), "
    "close decimal(18,2), pre_close decimal(18,2), pct_chg double, vol decimal(18,2), adj_factor decimal(18,6)"
)

FUNDAMENTALS = (
    "symbol string, report_end date, eps double, dt_eps double, bps double, roe double, roe_waa double, "
    "roe_dt double, dp_assets_to_eqt double, q_profit_yoy double, q_profit_qoq double, "
    "grossprofit_margin double, q_gsprofit_margin double, or_yoy double, q_sales_yoy double, "
    "capital_rese_ps double"
)

FORECAST = (
    "symbol string, ann_date date, end_date date, type string, p_change_min double, p_change_max double"
)

# Header of a broker ledger sheet, and our name for each column.
LEDGER_HEADER = {
    "币种": "currency",
    "证券名称": "security",
    "成交日期": "trade_date",
    "成交价格": "price",
    "成交数量": "quantity",
    "发生金额": "amount",
    "资金余额": "cash_balance",
    "剩余数量": "remaining_quantity",
    "合同编号": "contract_no",
    "业务名称": "business",
    "手续费": "fee",
    "印花税": "stamp_duty",
    "过户费": "transfer_fee",
    "结算费": "settlement_fee",
    "证券代码": "security_code",
    "股东代码": "holder_code",
}
LEDGER_COLUMNS = tuple(LEDGER_HEADER.values())


def conform(df: DataFrame, columns: Sequence[str], dtype: str = "string") -> DataFrame:
    """Exactly these columns in this order; an absent one is filled with NULL."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(dtype).alias(c) for c in columns])


def shaped(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a logical schema with their types; an absent one is filled with NULL."""
    fields = T.StructType.fromDDL(schema).fields
    return df.select(
        *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    )
