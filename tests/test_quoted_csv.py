"""CSV records cut from file ranges, against Python's own reader."""

import csv
import random

import pytest

from tickerloom.sources import quoted_csv as Q
from tickerloom.sources import readers


def fields(rng):
    words = ["a", "b,c", 'q"q', "two\nlines", "", "long " * rng.randrange(1, 60), 'end"', "\n\n", "é", "x\r\ny", '"', "plain"]
    return ["".join(rng.sample(words, rng.randrange(1, 3))) for _ in range(3)]


def written(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator=end).writerows([["k", "head line", "body"], *rows])
    return str(path)


@pytest.fixture
def small_ranges(spark):
    """Ranges of a few hundred bytes, so that records run over several of them."""
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_records_over_ranges(spark, tmp_path, small_ranges, seed):
    rng = random.Random(seed)
    rows = [[str(k), *fields(rng)[1:]] for k in range(120)]
    if seed == 2:
        rows[60][2] = "a very long body,\n" * 200  # whole ranges without an end of a record
    path = written(tmp_path / "n.csv", rows, "\r\n" if seed == 3 else "\n")
    got = readers.read_csv(spark, path, places=True)
    assert got.rdd.getNumPartitions() > 3
    found = got.orderBy(readers.ROW_ORDER).collect()
    assert [(r.k, r["head line"] or "", r.body or "") for r in found] == [tuple(r) for r in rows]
    assert len({tuple(r[readers.ROW_ORDER]) for r in found}) == len(rows)


def test_several_files_and_blank_lines(spark, tmp_path, small_ranges):
    folder = tmp_path / "many"
    folder.mkdir()
    rows = [[f"{k}", "two\nlines", "b" * k] for k in range(60)]
    written(folder / "a.csv", rows[:30])
    written(folder / "b.csv", rows[30:])
    (folder / "c.csv").write_text('k,head line,body\n\n99,"open\n\nend')
    got = readers.read_csv(spark, str(folder)).collect()
    assert {tuple(r) for r in got} == {(*r[:2], r[2] or None) for r in rows} | {("99", "open\n\nend", None)}


def test_stray_quotes_do_not_open_fields(spark, tmp_path, small_ranges):
    path = tmp_path / "s.csv"
    path.write_text("k,head line,body\n" + "".join(f'{k},5" screen,"a\n""b"""\n' for k in range(80)))
    got = readers.read_csv(spark, str(path)).collect()
    assert {(r.k, r["head line"], r.body) for r in got} == {(str(k), '5" screen', 'a\n"b"') for k in range(80)}


def test_malformed_records_drop_only_when_strict(spark, tmp_path, small_ranges):
    path = tmp_path / "m.csv"
    path.write_text("k,a,b\n" + '1,"x\ny",z\nshort,row\n2,b,c,extra\n3,d,e\n' * 40)
    assert readers.read_csv(spark, str(path)).count() == 160
    assert sorted(r.k for r in readers.read_csv(spark, str(path), strict=True).collect()) == ["1"] * 40 + ["3"] * 40


def test_empty_and_header_only_files(spark, tmp_path):
    path = tmp_path / "h.csv"
    path.write_text("k,a,b\n")
    assert readers.read_csv(spark, str(path)).collect() == [] and readers.read_csv(spark, str(path)).columns == ["k", "a", "b"]
    empty = tmp_path / "e.csv"
    empty.write_text("")
    assert readers.read_csv(spark, str(empty)).columns == []


@pytest.mark.parametrize("line, outside, inside", [
    ("a,b", False, True), ('"a', True, False), ('a"', False, False), ('"a"",b', True, False), ('"a","b', True, True), ('"",', False, True), ('x,""""', False, True), ("", False, True),
])
def test_state_behind_a_line(line, outside, inside):
    assert (Q.inside_after(line, False), Q.inside_after(line, True)) == (outside, inside)
