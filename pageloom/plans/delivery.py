"""Queries of the delivery operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.operators import dedup
from pageloom.session import table


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Surplus rows of result_rows."""
    return dedup.surplus_deliveries(table(spark, sf, "result_rows"), key=dedup.hex_key)


def p3_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Every message once: the kept rows."""
    rows = table(spark, sf, "result_rows")
    return rows.join(dedup.surplus_deliveries(rows, key=dedup.hex_key), "delivery_id", "left_anti").select(
        "delivery_id", dedup.hex_key().alias("msg_key"), "url", "ok"
    )


QUERIES = {"p3_found": p3_found, "p3_messages": p3_messages}

_KEY = "nullif(regexp_replace(lower(msg_id), '[^0-9a-f]', '', 'g'), '')"
_RANKED = f"""SELECT *, {_KEY} AS msg_key, row_number() OVER (PARTITION BY {_KEY} ORDER BY received_at, delivery_id) AS rn FROM result_rows"""
ORACLE = {
    "p3_found": f"SELECT delivery_id FROM ({_RANKED}) WHERE msg_key IS NOT NULL AND rn > 1",
    "p3_messages": f"SELECT delivery_id, msg_key, url, ok FROM ({_RANKED}) WHERE msg_key IS NULL OR rn = 1",
}
