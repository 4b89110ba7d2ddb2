import datetime as dt

from pyspark.sql import functions as F

from setloom.operators import provenance as V

SCHEMA = "game string, draw_date date, b1 int, note string"


def rows(spark, values):
    return spark.createDataFrame([(g, dt.date(2020, 1, d), b, n) for g, d, b, n in values], SCHEMA)


def test_digest_ignores_order_and_tells_nulls_apart(spark):
    base = [("g", 1, 5, "x"), ("g", 2, 6, None), ("g", 2, 6, None), ("h", 3, 1, "")]
    read = lambda v: {r.game: (r.rows, r.first_draw, r.last_draw, r.digest) for r in V.describe(rows(spark, v)).collect()}
    assert read(base) == read(base[::-1])
    assert read(base)["g"][:3] == (3, dt.date(2020, 1, 1), dt.date(2020, 1, 2))
    for other in ([*base[:2], base[3]], [*base[:2], ("g", 2, 6, ""), base[3]], [("g", 1, 6, "x"), ("g", 2, 5, None), base[2], base[3]]):
        assert read(other)["g"] != read(base)["g"] and read(other)["h"] == read(base)["h"]
    a = rows(spark, base)
    assert [r.digest for r in V.describe(a.select("note", "b1", "draw_date", "game")).orderBy("game").collect()] == [r.digest for r in V.describe(a).orderBy("game").collect()]


def test_verify_names_what_differs(spark, tmp_path):
    base = rows(spark, [("same", 1, 5, "x"), ("grown", 2, 6, "y"), ("gone", 3, 7, "z")])
    recorded = V.write(base, f"file://{tmp_path}/meta")
    now = rows(spark, [("same", 1, 5, "x"), ("grown", 2, 6, "y"), ("grown", 4, 6, "y"), ("new", 3, 7, "z")])
    found = {r.game: (r.ok, r.reason, r.rows_delta) for r in V.verify(now, recorded).collect()}
    assert found == {"same": (True, "matches", 0), "grown": (False, "content changed", 1), "gone": (False, "no rows", -1), "new": (False, "no metadata recorded", 1)}
    assert {r.reason for r in V.verify(now.withColumn("more", F.lit(1)), recorded).where("game = 'same'").collect()} == {"columns changed"}
    assert not V.verify(base.limit(0), recorded.limit(0)).collect()


def test_staleness_is_strict(spark):
    meta = V.describe(rows(spark, [("g", 1, 5, "x")]))
    assert [tuple(r) for r in V.staleness(meta, "2020-01-15").collect()] == [("g", 14, False)]
    assert [tuple(r) for r in V.staleness(meta, "2020-01-16").collect()] == [("g", 15, True)]


def test_delta_counts_each_key_once(spark):
    before = rows(spark, [("g", 1, 5, "x"), ("g", 2, 6, "y"), ("g", 3, 7, None)])
    after = rows(spark, [("g", 1, 5, "x"), ("g", 2, 6, None), ("g", 4, 7, None)])
    (r,) = V.delta(before, after, ["game", "draw_date"]).collect()
    assert (r.added, r.removed, r.changed, r.same) == (1, 1, 1, 1)


def test_tampering_is_found(spark):
    good = V.sealed(rows(spark, [("g", d, d, None if d % 2 else "n") for d in range(1, 20)]))
    assert V.tampered(good).count() == 0
    for change in ({"b1": F.col("b1") + 1}, {"note": F.coalesce("note", F.lit(""))}, {"seal": F.lit(None).cast("string")}, {"game": F.lit("h")}):
        bad = good.withColumns({c: F.when(F.col("draw_date") == "2020-01-05", x).otherwise(F.col(c)) for c, x in change.items()})
        assert [r.draw_date.day for r in V.tampered(bad).collect()] == [5]
