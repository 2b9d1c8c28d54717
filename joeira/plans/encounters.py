"""Admissions made from the order tables, with known faults mixed in.

One row per order; ``row_idx`` is the order key.  The faults follow from the
key alone, so both engines of a comparison see the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

COLUMNS = (
    "row_idx", "ID", "processo", "nome", "data_ent", "data_alta", "destino", "sexo", "data_nasc", "origem",
)
_FROM_CUSTOMER = {"nome", "sexo", "origem"}


def _text(c: Column) -> Column:
    return c.cast("string")


def _dmy(d: Column) -> Column:
    return F.concat_ws("-", _text(F.day(d)), _text(F.month(d)), _text(F.year(d)))


def _expressions() -> dict[str, Column]:
    k, d, seg = F.col("o_orderkey"), F.col("o_orderdate").cast("date"), F.col("c_mktsegment")

    def every(n: int) -> Column:
        return k % n == 0

    id_year = (F.year(d) + F.when(every(53), 1).otherwise(0)) % 100
    discharge = F.date_add(d, (k % 90 - 5).cast("int"))
    return {
        "row_idx": k,
        "ID": F.when(every(97), F.lit(None))
        .when(every(89), F.concat(F.lit("X"), _text(F.floor(k / 89) % 40)))
        .otherwise(F.concat(F.lpad(_text(id_year), 2, "0"), F.lpad(_text(k % 997), 3, "0"))),
        "processo": F.when(every(61), F.lit(None))
        .when(every(59), F.concat(F.lit("P/"), _text(F.col("o_custkey"))))
        .otherwise(_text(F.col("o_custkey"))),
        "nome": F.when(every(101), F.lit("")).otherwise(F.col("c_name")),
        "data_ent": F.when(every(83), F.lit(""))
        .when(every(79), F.concat(F.lit("31-02-"), _text(F.year(d))))
        .when(every(73), F.concat_ws("/", _text(F.year(d)), _text(F.month(d)), _text(F.day(d))))
        .otherwise(_dmy(d)),
        "data_alta": F.when(~every(11), _dmy(discharge)),
        "destino": F.col("o_orderpriority"),
        "sexo": F.when(seg.isin("BUILDING", "HOUSEHOLD"), F.lit("M"))
        .when(seg == "MACHINERY", F.lit("F"))
        .when(seg == "FURNITURE", F.lit("f")),
        "data_nasc": F.concat_ws("-", _text(1 + k % 28), _text(1 + k % 12), _text(1890 + k % 115)),
        "origem": seg,
    }


def encounters(spark: SparkSession, sf_dir: str, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """The wanted columns of the admissions table.

    A customer key is unique, so the join only adds columns: it is left out
    when none of them is asked for.
    """
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    if _FROM_CUSTOMER & set(columns):
        customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
        rows = rows.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    made = _expressions()
    return rows.select(*[made[c].alias(c) for c in columns])
