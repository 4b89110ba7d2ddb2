import datetime as dt

import pytest

from setloom.sources import readers


def text(tmp_path, name, content):
    path = tmp_path / name
    path.write_text(content, encoding="utf-8")
    return f"file://{path}"


def test_header_variants(spark, tmp_path):
    path = text(tmp_path, "a.csv", " Date , Ball1,Ball2,Ball3,Ball4,Ball5, Lucky Star1,Lucky Star2\n2020-01-03,1,2,3,4,5,6,7\n2020-01-07,1,2,x,4,5,6,7\n")
    made = readers.read_draws(spark, path).collect()
    assert [tuple(r) for r in made] == [(dt.date(2020, 1, 3), 1, 2, 3, 4, 5, 6, 7)]


def test_missing_columns_are_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="ball_3"):
        readers.read_draws(spark, text(tmp_path, "b.csv", "Date,Ball1,Ball2\n2020-01-03,1,2\n"))
    with pytest.raises(ValueError, match="2 columns"):
        readers.read_positional(spark, text(tmp_path, "c.csv", "2020-01-03,1\n"))
    with pytest.raises(ValueError, match="numbers"):
        readers.read_jackpots(spark, text(tmp_path, "d.csv", "draw,note\n1,a\n"), "draw")


def test_lines(spark, tmp_path):
    path = text(tmp_path, "e.txt", "On 3/2/2001 draw 7: 1 2 3 4 5 + 6 7\n2001-02-30: 1 2 3 4 5 6 7\nnothing\n")
    assert [tuple(r) for r in readers.parse_lines(spark, path).collect()] == [(dt.date(2001, 2, 3), 1, 2, 3, 4, 5, 6, 7)]
    path = text(tmp_path, "f.txt", "1\t2 3\t4\t5\t6\t7\r\n1 2 3\n")
    assert [tuple(r) for r in readers.read_numbers(spark, path).collect()] == [(1, 2, 3, 4, 5, 6, 7)]


def test_upsert_keeps_the_newest(spark, tmp_path):
    day = dt.date(2020, 1, 3)
    old = spark.createDataFrame([("g", day, 1, 10), ("g", day, 9, 11)], "game string, draw_date date, draw_id long, b1 int")
    new = spark.createDataFrame([("g", day, 2, 12), ("h", day, 3, 13)], old.schema)
    made = readers.upsert(old, new, f"file://{tmp_path}/u").collect()
    assert sorted((r.game, r.draw_id, r.b1) for r in made) == [("g", 2, 12), ("h", 3, 13)]


def test_proposals_with_repeats_and_without_rows(spark, tmp_path):
    rows = [("a", 1, [1, 2, 3, 4, 5], [1, 2], 0.0), ("a", 2, [1, 2, 3, 4, 5], [1, 2], 0.0), ("b", 3, [1, 2, 3, 4, 60], [1, 2], 0.0), ("c", 4, [1, 2, 3, 4, 6], [1, 2], 0.0)]
    readers.write_proposals(spark.createDataFrame(rows, "method string, ticket_id long, main array<int>, star array<int>, score double"), f"file://{tmp_path}/p")
    declared = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1), ("d", 1)], "method string, budget long")
    made = {r.method: (r.tickets, r.legal, r.different, r.valid) for r in readers.validate_proposals(spark, f"file://{tmp_path}/p", declared).collect()}
    assert made == {"a": (2, 2, 1, False), "b": (1, 0, 1, False), "c": (1, 1, 1, True), "d": (0, 0, 0, False)}
