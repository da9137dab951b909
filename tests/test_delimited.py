import csv
import random

import pytest
from pyspark.sql import functions as F

from labelmill.sources import delimited as D

EXCUSES = 'excuse,context,timestamp\n"My alarm, again","It said ""no""","2024-03-15 09:45"\nTraffic,"two\nlines",2024-03-18\n'


def put(tmp_path, name, text):
    (tmp_path / name).write_bytes(text.encode())
    return str(tmp_path / name)


@pytest.mark.parametrize("text, sep", [
    ("col_a,col_b,col_c\n1,2,3\n", ","), ("col_a;col_b;col_c\n", ";"), ("col_a\tcol_b\tcol_c\n", "\t"), ("col_a|col_b|col_c\n", "|"),
    ("col_a\n1\n", ","), ("a,b;c\n", ","), ("a,b;c;d\n", ";"), ("\ufeffa;b\n", ";"), ("", ","), ("a\n;;;;\n", ","),
])
def test_separators(spark, tmp_path, text, sep):
    assert D.detect_separator(spark, put(tmp_path, "x.csv", text)) == sep


def test_separators_of_many_files(spark, tmp_path):
    put(tmp_path, "a.csv", "a;b\n1;2\n")
    put(tmp_path, "b.csv", "a,b\n1,2\n")
    assert D.detect_separator(spark, str(tmp_path)) == ";"
    with pytest.raises(ValueError, match="different separators"):
        D.detect_separator(spark, str(tmp_path), per_file=True)


def test_dates_stay_text(spark, tmp_path):
    df = D.read_delimited(spark, put(tmp_path, "x.csv", EXCUSES))
    assert dict(df.dtypes) == {"excuse": "string", "context": "string", "timestamp": "string"}
    assert [tuple(r) for r in df.collect()] == [("My alarm, again", 'It said "no"', "2024-03-15 09:45"), ("Traffic", "two\nlines", "2024-03-18")]


def test_types_and_id_column(spark, tmp_path):
    path = put(tmp_path, "x.csv", "id;score;flag;name\n007;1.5;true;a\n008;2;false;\n")
    assert dict(D.read_delimited(spark, path).dtypes) == {"id": "int", "score": "double", "flag": "boolean", "name": "string"}
    df = D.read_delimited(spark, path, id_column="id")
    assert [tuple(r) for r in df.collect()] == [("007", 1.5, True, "a"), ("008", 2.0, False, None)]


def test_number_pattern_holds_all_that_can_be_cast(spark):
    rng = random.Random(4)
    parts = ["1", "0", "+", "-", ".", "e", "E", "d", "F", "0x", "p", "a", "nan", "NaN", "inf", "Infinity", " ", "\t", "\x01", "\n", "\u2028", "_", "L", "٣", "ſ", "K", "true",
             "False", "2147483647", "2147483648", "-2147483649", "9223372036854775807", "9223372036854775808"]
    cells = sorted({"".join(rng.choice(parts) for _ in range(rng.randint(1, n))) for n in (2, 4) for _ in range(8000)})
    cell = F.col("cell")
    whole = F.when(cell.rlike("^[+-]?[0-9]+$"), cell)
    want = (F.when(whole.try_cast("int").isNotNull(), 1).otherwise(0) + F.when(whole.try_cast("bigint").isNotNull(), 2).otherwise(0)
            + F.when(cell.try_cast("double").isNotNull() & ~cell.rlike(r"^\s|\s$"), 4).otherwise(0) + F.when(F.lower(cell).isin("true", "false"), 8).otherwise(0))
    found = spark.createDataFrame([(c,) for c in [*cells, None]], "cell string").groupBy("cell").agg(D._fits(cell).alias("fits"))
    assert found.where("cell is null").first().fits is None
    assert found.where(cell.isNotNull() & ~F.col("fits").eqNullSafe(want)).collect() == []
    assert {r.fits for r in found.select("fits").distinct().collect()} >= {0, 2, 3, 4, 6, 7, 8}


def test_no_cast_of_what_is_no_number(spark):
    """A cast of text to a double fails slowly; only cells that look like numbers may come to it."""
    assert not spark.createDataFrame([("1998-02-06 00:00:00",), ("5-LOW",), ("F",), ("1-2",), (".",), ("e5",)], "c string").where(F.col("c").rlike(D._NUMBER)).count()


def test_check(spark, tmp_path):
    path = put(tmp_path, "x.csv", "a,b\n1,2\n3,4\n")
    assert D.check_delimited(spark, path, ["a"]) == (True, "", 2, 2)
    assert D.check_delimited(spark, path, ["a", "c", "d"]) == (False, "Missing columns: c, d", 2, 2)
    bad = D.check_delimited(spark, str(tmp_path / "none.csv"), ["a"])
    assert not bad.ok and bad.message.startswith("Cannot read the files: ") and bad[2:] == (0, 0)


def test_roundtrip(spark, tmp_path):
    rows = [(1, " padded ", 'q"uote', "line\nbreak"), (2, "", "a,b;c|d\te", None), (3, "\\", "é", "x")]
    df = spark.createDataFrame(rows, "id bigint, a string, b string, c string")
    for i, sep in enumerate(D.SEPARATORS):
        path = str(tmp_path / f"out{i}")
        D.write_delimited(df, path, sep, single_file=i == 0)
        back = D.read_delimited(spark, path, schema=df.schema)
        assert sorted(tuple(r) for r in back.collect()) == rows


@pytest.fixture
def small_blocks(spark):
    """Blocks of a few hundred bytes, so that records and cells lie across many of them."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("300", "0"), strict=True):
        spark.conf.set(n, v)
    yield
    for n, v in zip(names, old, strict=True):
        spark.conf.set(n, v)


def write_csv(path, names, rows, sep, end, rng, bom=False):
    with open(path, "w", newline="", encoding="utf-8-sig" if bom else "utf-8") as f:
        writer = csv.writer(f, delimiter=sep, lineterminator=end)
        writer.writerow(names)
        for r in rows:
            writer.writerow(r)
            if rng.random() < 0.05:
                f.write(end)  # an empty line is no record


def test_line_breaks_in_split_files(spark, tmp_path, small_blocks):
    rng = random.Random(8)
    cells = ["a", "b,c", 'x"y', "line\nbreak", '"', "\r\n", "", " sp ", 'é\n\n\n"q"', ";", "\n" * 400, '""\n""', "1"]
    rows = [[str(i), *[rng.choice(cells) for _ in range(3)]] for i in range(300)]
    for j, (sep, end) in enumerate([(";", "\n"), (",", "\r\n"), ("\t", "\n")]):
        write_csv(tmp_path / f"f{j}.csv", ["id", "a", 'b "q"', "a"], rows[j * 100 : j * 100 + 100], sep, end, rng, bom=j == 1)
    df = D.read_delimited(spark, str(tmp_path))
    assert df.columns == ["id", "a1", 'b "q"', "a3"] and dict(df.dtypes)["id"] == "int"
    assert sorted(tuple(r) for r in df.collect()) == [(int(r[0]), *[c or None for c in r[1:]]) for r in rows]
    assert spark.read.text(str(tmp_path / "f0.csv")).rdd.getNumPartitions() > 20
    assert sorted(tuple(r) for r in D.read_delimited(spark, str(tmp_path), infer=False, id_column="id").select("id").collect()) == sorted((r[0],) for r in rows)
    # Sums over blocks are the only ordering of a whole file; they have a row for each block.
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Python" not in plan


@pytest.mark.parametrize("most, pieces", [(4000, False), (500, True)])
def test_many_files_in_one_task(spark, tmp_path, small_blocks, most, pieces):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(most))
    rng, rows = random.Random(5), []
    cells = ["a", "line\nbreak", '"', "\n\n", "b,c", "", '"\n"', "x" * 90]
    for j in range(40):
        part = [[f"{j}-{i}", *[rng.choice(cells) for _ in range(2)]] for i in range(rng.randint(0, 12))]
        write_csv(tmp_path / f"f{j}.csv", ["id", "a", "b"], part, ",;"[j % 2], "\n", rng, bom=j % 5 == 0)
        rows += part
    put(tmp_path, "empty.csv", "")
    put(tmp_path, "blank.csv", "\n\r\n\n")
    text = spark.read.text(str(tmp_path))
    files = {tuple(sorted(f.rsplit("/", 1)[-1] for f in found)) for found in text.selectExpr("_metadata.file_path f").rdd.mapPartitions(lambda i: [{r.f for r in i}]).collect()}
    assert max(map(len, files)) > 1 and (text.rdd.getNumPartitions() > 10) == pieces
    df = D.read_delimited(spark, str(tmp_path), infer=False)
    assert sorted(tuple(r) for r in df.collect()) == sorted((r[0], *[c or None for c in r[1:]]) for r in rows)
    assert D.check_delimited(spark, str(tmp_path), ["b"]) == (True, "", len(rows), 3)


def test_records_of_one_line_do_not_move(spark, tmp_path):
    path = put(tmp_path, "x.csv", 'a,b\n1,"x,""y"""\n\n2,z\n')
    df = D.read_delimited(spark, path)
    assert sorted(tuple(r) for r in df.collect()) == [(1, 'x,"y"'), (2, "z")]
    assert "hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()


def test_other_pieces_are_an_error(spark, tmp_path, small_blocks):
    path = put(tmp_path, "x.csv", "a,b\n" + "".join(f'{i},"{i}\n"\n' for i in range(200)))
    df = D.read_delimited(spark, path, infer=False)
    assert df.count() == 200
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    with pytest.raises(Exception, match="split for tasks in another way"):
        D.read_delimited(spark, path, infer=False).unionByName(df).count()


def test_check_parses_no_cell(spark, tmp_path, monkeypatch):
    path = put(tmp_path, "x.csv", 'a,b\n1,"two\nlines"\n\n2,"' + "," * 500 + '"\n')
    monkeypatch.setattr(D, "_parsed", None)
    assert D.check_delimited(spark, path, ["b"]) == (True, "", 2, 2)


def test_check_of_records_with_many_separators(spark, tmp_path):
    many = "," * 12000
    fine = put(tmp_path, "fine.csv", f'a,b\n1,"{many}\n{many}"\n2,{many}\n')
    assert D.check_delimited(spark, fine, ["b"]) == (True, "", 2, 2)
    for record in (f"{many}{many}", f'{many},"\n"{many}'):  # more cells than the parser takes
        bad = D.check_delimited(spark, put(tmp_path, "bad.csv", f"a,b\n{record}\n"), ["b"])
        assert not bad.ok and bad.message.startswith("Cannot read the files: ") and bad[2:] == (0, 0)


def test_one_way_and_another_agree(spark, tmp_path):
    rng = random.Random(3)
    rows = [[rng.choice(["1", "-2", "+3", "9999999999", "1.5", "1e3", "true", "False", "", "x", "007", " 4"]) for _ in range(2)] for _ in range(6)]
    for i in range(12):
        part = rng.sample(rows, 3)
        path = str(tmp_path / f"{i}.csv")
        write_csv(path, ["p", "q"], part, ",", "\n", rng)
        split, whole = (D.read_delimited(spark, path, multi_line=m) for m in (True, "whole"))
        assert split.dtypes == whole.dtypes and sorted(map(str, split.collect())) == sorted(map(str, whole.collect())), part


def test_files_that_do_not_fit_together(spark, tmp_path):
    put(tmp_path, "a.csv", "a;b\n1;2\n")
    put(tmp_path, "b.csv", "a,c\n1,2\n")
    with pytest.raises(ValueError, match="different columns"):
        D.read_delimited(spark, str(tmp_path))
    with pytest.raises(ValueError, match="No header"):
        D.read_delimited(spark, put(tmp_path, "empty.txt", ""))
    with pytest.raises(ValueError, match="several lines"):
        D.read_delimited(spark, put(tmp_path, "long.txt", '"a\nb",c\n1,2\n'))
    assert D.read_delimited(spark, put(tmp_path, "bare.txt", "a,b\n")).count() == 0
