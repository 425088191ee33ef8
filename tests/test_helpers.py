"""Order statistics and ordered scans against plain Python, also where groups are large or keys are null."""

import random
import statistics

from pyspark.sql import functions as F

from sheetledger.operators.ordered import islands, neighbour, numbered, running
from sheetledger.operators.quantiles import exact_quantiles, median_by

from conftest import rows


def test_exact_quantiles_on_a_large_skewed_group(spark):
    rnd = random.Random(3)
    data = [("hot", rnd.choice([rnd.gauss(0, 1), float(rnd.randint(0, 3))])) for _ in range(30_000)] + [("cold", float(i)) for i in range(7)] + [("none", None)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", {"m": 0.5, "p95": 0.95}, count_as="n").collect()}
    hot = sorted(v for k, v in data if k == "hot")
    assert set(got) == {"hot", "cold"} and got["hot"].n == 30_000
    assert abs(got["hot"].m - statistics.median(hot)) < 1e-12
    at = 0.95 * (len(hot) - 1)
    want = hot[int(at)] + (hot[int(at) + 1] - hot[int(at)]) * (at - int(at))
    assert abs(got["hot"].p95 - want) < 1e-12
    assert got["cold"].m == 3.0


def test_ranked_quantile_is_not_interpolated(spark):
    df = spark.createDataFrame([(float(v),) for v in (10, 20, 30, 40)], "v double")
    assert rows(exact_quantiles(df, [], "v", {"a": 0.5, "b": 0.9}, method="index")) == [(30.0, 40.0)]
    assert rows(median_by(df, [], "v")) == [(25.0,)]


def test_neighbour_and_running_cross_parts_and_null_keys(spark):
    data = [(k, t) for k in ("a", None) for t in (1, 2, 11, 12, 35)]
    df = spark.createDataFrame(data, "k string, t int")
    lag = neighbour(df, ["k"], ["t"], {"prev": "t"}, -1)
    assert rows(lag.where("k is null"), "t", "prev") == [(1, None), (2, 1), (11, 2), (12, 11), (35, 12)]
    lead = neighbour(df, ["k"], ["t"], {"nxt": "t"}, 1)
    assert rows(lead.where("k = 'a'"), "t", "nxt") == [(1, 2), (2, 11), (11, 12), (12, 35), (35, None)]
    total = running(df, ["k"], ["t"], F.col("t"), "s")
    assert rows(total.where("k = 'a'"), "t", "s") == [(1, 1), (2, 3), (11, 14), (12, 26), (35, 61)]
    back = running(df, ["k"], ["t"], F.col("t"), "s", before=True, reverse=True)
    assert rows(back.where("k = 'a'"), "t", "s") == [(1, 60), (2, 58), (11, 47), (12, 35), (35, 0)]
    assert rows(numbered(df, ["k"], ["t"]).where("k = 'a'"), "t", "seq") == [(1, 1), (2, 2), (11, 3), (12, 4), (35, 5)]
    runs = islands(lag, ["k"], ["t"], F.col("prev").isNull() | (F.col("t") - F.col("prev") > 5))
    assert rows(runs.where("k = 'a'"), "t", "island") == [(1, 1), (2, 1), (11, 2), (12, 2), (35, 3)]


def test_component_marks_and_what_only_looks_like_one(spark):
    from sheetledger.functions.strings import component_mark

    # fixed values: marks with their kinds, and strings of the same shape that are none
    kinds = {"KZZ3": "column", "KZ1": "column", "GZ2": "column", "YBZ1": "wall", "GBZ12": "wall", "AZ1": "wall", "YZ1": "wall", "KL1(3A)": "beam", "L999": "beam", "LB1": "slab",
             "M1124": "door", "M0824": "door", "C1518": "window", "C1": "window", "FM1": "door", "MC1": "door"}
    none = ["C65H-C16A/2P+V", "C16A/1P+N", "C30", "M10", "M7.5", "C12@200", "2C25", "", "KZ", "123", "M0", "Q0", "KZ0", "q35", "L1200", "KZ1234", "Q9999", "C769", "M0000", "C0102", "Q235", "Q355", "±0.000", None]
    texts = [*kinds, *none]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {texts[r.i]: r.kind for r in df.select("i", component_mark(F.col("t")).kind.alias("kind")).collect()}
    assert got == {**kinds, **dict.fromkeys(none)}


def test_file_names_with_stage_segments(spark):
    from sheetledger.functions.strings import parse_name

    # fixed values: names with the number, the title and the discipline they carry
    cases = [("基坑支护-竣工图-01-基坑围护设计施工总说明.pdf", "01", "基坑围护设计施工总说明", "structure"), ("结构-竣工图-S-31-07A-首层框架梁平面整体配筋图.pdf", "S-31-07A", "首层框架梁平面整体配筋图", "structure"),
             ("装饰-竣工图-I-10-02-A- 2F平面布置图.pdf", "I-10-02", "2F平面布置图", "decoration"), ("幕墙-竣工图-C1-H58-C1玻璃幕墙横剖节点详图.pdf", "C1-H58", "C1玻璃幕墙横剖节点详图", "architecture"),
             ("电气-竣工图-ZNH-20-102-四层公共广播及紧急广播平面图（二）.pdf", "ZNH-20-102", "四层公共广播及紧急广播平面图（二）", "mep"),
             ("结构-竣工图-ST-41-032C--楼梯ST-28、29、30结构详图.pdf", "ST-41-032C", "楼梯ST-28、29、30结构详图", "structure"), ("竣工图.pdf", "竣工图", "竣工图", "general")]
    df = spark.createDataFrame([(c[0],) for c in cases], "n string").select("n", parse_name(F.col("n")).alias("p"))
    assert {(r.n, r.p.number, r.p.title, r.p.discipline) for r in df.collect()} == set(cases)


def test_places_of_every_kind(spark):
    from sheetledger.functions.strings import locations

    text = "结施-12 第3页 地上二层 B2 1-5轴 交A轴 节点详图3 空调系统 水泵房 屋顶 消防喷淋泵 AHU-1"
    got = spark.createDataFrame([(text,)], "t string").select(locations(F.col("t")).alias("l")).first().l
    assert "第3页" in got.drawings and "地上二层" in got.levels and "1-5轴" in got.axes and "交A轴" in got.axes
    assert got.spaces and any(e.endswith("喷淋泵") for e in got.equipment) and "AHU-1" in got.equipment
