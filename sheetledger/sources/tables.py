"""Typed scans (explicit schema, so no inference job and no surprise columns)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_L, _I, _D, _S, _TS = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


SCHEMAS: dict[str, T.StructType] = {
    "region": _schema(r_regionkey=_I, r_name=_S),
    "nation": _schema(n_nationkey=_I, n_name=_S, n_regionkey=_I),
    "customer": _schema(c_custkey=_L, c_name=_S, c_nationkey=_I, c_acctbal=_D, c_mktsegment=_S),
    "supplier": _schema(s_suppkey=_L, s_name=_S, s_nationkey=_I, s_acctbal=_D),
    "part": _schema(p_partkey=_L, p_name=_S, p_brand=_S, p_type=_S, p_size=_I, p_retailprice=_D),
    "orders": _schema(o_orderkey=_L, o_custkey=_L, o_orderstatus=_S, o_totalprice=_D,
                      o_orderdate=_TS, o_orderpriority=_S),
    "lineitem": _schema(l_orderkey=_L, l_partkey=_L, l_suppkey=_L, l_linenumber=_I, l_quantity=_D,
                        l_extendedprice=_D, l_discount=_D, l_tax=_D, l_returnflag=_S,
                        l_linestatus=_S, l_shipdate=_TS),
    "events": _schema(event_id=_L, ts=_TS, user_id=_L, event_type=_S, value=_D, props=_S),
    "documents": _schema(doc_id=_L, text=_S, lang=_S, source=_S, n_chars=_L),
    "benchmark": _schema(item_id=_L, text=_S),
    "labels": _schema(doc_id=_L, quality=_I, toxic=_I),
    "conversations": _schema(conv_id=_L, turn=_L, role=_S, text=_S),
    "pages": _schema(page_id=_L, url=_S, html=_S),
    "embeddings": T.StructType([
        T.StructField("vec_id", _L), T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", _I)]),
}


def read_table(spark: SparkSession, directory: str, name: str, fmt: str = "parquet") -> DataFrame:
    """Scan one table with its declared schema; filters and columns push into the scan."""
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.format(fmt).load(f"{directory.rstrip('/')}/{name}.{fmt}")
