import datetime

from setloom.sources import checks


def test_bounds(spark):
    rows = [(1, "5", 2.0), (2, " 7", 0.5), (3, "x", None), (4, None, 9.0), (5, "11", float("nan")), (6, "10", 1.0)]
    frame = spark.createDataFrame(rows, "id int, a string, `b c` double")
    valid, wrong = checks.validate(frame, ["id"], {"a": (1, 10), "b c": (1, 5), "d": (0, 1)})
    assert sorted((r.id, r.a) for r in valid.collect()) == [(1, 5.0), (6, 10.0)]
    found = {(r.id, r.column, r.problem, r.value) for r in wrong.collect()}
    assert found == {(2, "b c", "out of range", "0.5"), (3, "a", "not a number", "x"), (3, "b c", "missing", None), (4, "a", "missing", None), (4, "b c", "out of range", "9.0"), (5, "a", "out of range", "11"), (5, "b c", "not a number", "NaN"), (None, "d", "no such column", None)}
    valid, wrong = checks.validate(frame.limit(0), ["id"], {"a": (1, 10)})
    assert valid.count() == wrong.count() == 0
    valid, wrong = checks.validate(frame, ["id"], {"d": (0, 1)})
    assert valid.count() == 6 and wrong.count() == 1


def test_pages(spark):
    text = "<li>1</li> 2024-01-02 <ul><LI class='x'> 3 </LI><li>4</li></ul><li>a5</li> 2024-01-05<tr><td>6</td><td>7</td><td>8</td></tr> 2024-01-09 <li>9</li> 2024-13-40 <li>1</li><li>2</li>"
    pages = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "2024-02-03"), (1, text)], "page_id int, html string")
    made = sorted((r.page_id, r["at"], r.draw_date, r.numbers) for r in checks.draw_pages(pages, 2).collect())
    one = [(1, 1, datetime.date(2024, 1, 2), [3, 4]), (1, 2, datetime.date(2024, 1, 5), [6, 7])]
    assert made == sorted(one * 2)
