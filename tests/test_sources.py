"""Shop settings as a data source, page patterns, and JSON walked as variants."""

import json

from pyspark.sql import functions as F

from shelfwise.sources import config as C
from shelfwise.sources import paging as P
from shelfwise.sources import walks as W


def test_shop_config(spark, tmp_path):
    (tmp_path / "shops.txt").write_text("﻿# shops\n\na | Shop A | printer | https://a.example\nb|B|filament|\nbroken line\n|no id|x|y\na|Newer A|both|https://a.example/2\n", encoding="utf-8")
    got = C.read_config(spark, str(tmp_path / "shops.txt"))
    rows = [tuple(r) for r in got.orderBy("line").collect()]
    assert rows == [("a", "Shop A", "printer", "https://a.example", 3, None), ("b", "B", "filament", None, 4, None), (None, None, None, None, 5, "broken line"), (None, None, None, None, 6, "|no id|x|y"), ("a", "Newer A", "both", "https://a.example/2", 7, None)]
    assert {(r.id, r.name) for r in C.good_records(got).collect()} == {("a", "Newer A"), ("b", "B")}
    (tmp_path / "more").mkdir()
    for n in ("x.txt", "y.txt", "_skip"):
        (tmp_path / "more" / n).write_text(f"{n}|aisle\n", encoding="utf-8")
    two = C.read_config(spark, f"file://{tmp_path}/more", fields="slug,aisle")
    assert two.columns == ["slug", "aisle", "line", "corrupt"] and sorted(r.slug for r in two.collect()) == ["x.txt", "y.txt"]
    assert C.read_config(spark, str(tmp_path / "none.txt"), fallback=str(tmp_path / "shops.txt")).count() == 5
    assert C.read_config(spark, str(tmp_path / "none.txt")).count() == 0


def test_page_patterns(spark):
    s = "https://s.example"
    cases = [
        (f"{s}/list", f"{s}/list?page=2", f"{s}/list?page=3"), (f"{s}/list?sort=a", f"{s}/list?sort=a&sayfa=2", f"{s}/list?sort=a&sayfa=3"), (f"{s}/list?sort=a", f"{s}/list?page=2&sort=a", f"{s}/list?page=3&sort=a"),
        (f"{s}/list?p=0", f"{s}/list?p=24", f"{s}/list?p=48"), (f"{s}/list/page/1/", f"{s}/list/page/2/", f"{s}/list/page/3/"), (f"{s}/list/", f"{s}/list/page/2/", f"{s}/list/page/3/"), (f"{s}/list", f"{s}/list/2", f"{s}/list/3"),
        (f"{s}/l9?pg=9", f"{s}/l9?pg=10", f"{s}/l9?pg=11"), (f"{s}/list?id=5", f"{s}/list?id=6", None), (f"{s}/list", f"{s}/list", None), (f"{s}/list", "https://t.example/list?page=2", None), (f"{s}/a-1", f"{s}/a-2", None), (f"{s}/list", f"{s}/other", None), (None, f"{s}/x", None),
        (f"{s}/es/12", f"{s}/es/12?page=2", f"{s}/es/12?page=3"), (f"{s}/l?p=19", f"{s}/l?p=110", f"{s}/l?p=201"), (f"{s}/l/20/?x=1", f"{s}/l/30/?x=1", f"{s}/l/40/?x=1"), (f"{s}/list?page=1#top", f"{s}/list?page=2", f"{s}/list?page=3"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, first string, second string, third string").withColumn("p", P.pattern(F.col("first"), F.col("second")))
    got = df.select("i", "third", P.page_at(F.col("p"), F.lit(3), F.col("first")).alias("at"), P.next_of(F.col("p"), F.col("second"), F.col("first")).alias("next"), P.page_of(F.col("p"), F.col("second"), F.col("first")).alias("n")).orderBy("i").collect()
    assert [r["at"] for r in got] == [c[2] for c in cases] and [r["next"] for r in got] == [c[2] for c in cases]
    assert [r.n for r in got] == [2 if c[2] else None for c in cases]
    far = df.where("i = 0").select(P.next_of(F.col("p"), F.lit(f"{s}/list?page=40"), F.col("first")), P.page_of(F.col("p"), F.lit(f"{s}/list?page=x"), F.col("first")), P.next_of(F.col("p"), F.col("first"), F.col("first"))).first()
    assert tuple(far) == (None, None, f"{s}/list?page=2")
    of_host = {r.host: (tuple(r.pattern), r.lists) for r in P.host_patterns(df.select("first", "second")).collect()}
    assert of_host == {"s.example": (("?page=", 1, 1), 4)}


def slow_named(text):
    try:
        todo = [json.loads(text or "null")]
    except ValueError:
        return []
    out = []
    while todo:
        node = todo.pop()
        if isinstance(node, dict):
            names = [x.strip() for x in (node.get("name"), node.get("title")) if isinstance(x, str) and x.strip()]
            out += [(names[0], node["url"] if isinstance(node.get("url"), str) else None)] if names else []
            todo += node.values()
        elif isinstance(node, list):
            todo += node
    return out


def test_json_of_any_shape(spark):
    texts = ['{"a":[{"title":" T ","x":{"name":"N","url":"u"}}],"name":3}', "{broken", None, "[]", "3", '{"name":"","title":"Z","url":5,"more":[[{"name":"deep","url":"v"}],null,true]}', '[{"name":"one"},{"name":"one"}]', '{"' + "a" * 50 + '":' * 1 + "1}"]
    deep = '{"x":' * 30 + '{"name":"bottom"}' + "}" * 30
    rows = spark.createDataFrame(list(enumerate([*texts, deep])), "id int, text string").withColumn("v", F.lit("clash")).withColumn("k", F.lit(1))
    got = sorted(((r.id, r.name, r.url) for r in W.named_objects(rows, "id", "text").collect()), key=repr)
    assert got == sorted([(i, *x) for i, t in enumerate([*texts, deep]) for x in slow_named(t)], key=repr)
    assert W.named_objects(rows.limit(0), "id", "text").count() == 0


def test_schema_org_products(spark):
    texts = [
        '{"@graph":[{"@type":"WebSite","name":"w"},{"@type":["Thing","Product"],"name":"P","offers":[{"price":"x"},{"price":"12.5","priceCurrency":"TRY"}]}]}',
        '{"@type":"Product","name":"Q","offers":{"lowPrice":7,"priceCurrency":"USD"},"isRelatedTo":[{"@type":"product","name":"R","price":3}]}', '{"@type":"Product"}', "{oops",
    ]
    got = sorted(map(tuple, W.products(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text").collect()), key=repr)
    assert got == sorted([(0, 2, "P", 12.5, "TRY"), (1, 0, "Q", 7.0, "USD"), (1, 2, "R", 3.0, None), (2, 0, None, None, None)], key=repr)
