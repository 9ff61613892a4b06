"""Files whose cells go on over line breaks, read by many tasks, give the rows of a reader that starts at the top."""
import random

import pytest

from cohort_gaps.sources import text_tables
from cohort_gaps.sources.text_tables import ORDER, read_text_table


def quoted(cell):
    return '"' + cell.replace('"', '""') + '"'


def write(path, n, seed, encoding="utf-8", end="\n"):
    rng = random.Random(seed)
    pieces = ["a", "é", ",", "\n", '"', " ", "12", "\n\n", "long word ", '",']
    lines = [["id", "name", "note"]]
    for i in range(n):
        lines.append([str(i), "".join(rng.choices(pieces, k=rng.randint(0, 12))), rng.choice(["", "x", "y\nz"])])
    text = end.join(",".join(cell if cell.isalnum() or not cell else quoted(cell) for cell in line) for line in lines) + end
    path.write_bytes(text.encode(encoding))
    return lines[1:]


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("seed,encoding", [(1, "utf-8"), (2, "cp1252"), (3, "utf-8")])
def test_rows_and_their_order(spark, tmp_path, small_ranges, seed, encoding):
    file = tmp_path / "t.csv"
    expected = write(file, 300, seed, encoding)
    records = text_tables._records(spark, str(file), "utf-8" if encoding == "utf-8" else encoding)
    assert records is not None and records.count() == 301
    assert spark.read.text(str(file)).rdd.getNumPartitions() > 5
    rows = read_text_table(spark, str(file)).orderBy(ORDER).collect()
    assert [[r["id"], r["name"], r["note"]] for r in rows] == expected
    whole = spark.read.csv(str(file), header=True, multiLine=True, quote='"', escape='"',
                           encoding="UTF-8" if encoding == "utf-8" else "ISO-8859-1").collect()
    assert [[c or "" for c in r] for r in whole] == expected


def test_a_cell_longer_than_several_ranges(spark, tmp_path, small_ranges):
    file = tmp_path / "t.csv"
    long = "\n".join(f"line {i}" for i in range(500))
    file.write_text(f'\n\nid,note\n1,"{long}"\n\n2,"b\nc"\n3,d\n')
    rows = read_text_table(spark, str(file)).orderBy(ORDER).collect()
    assert [(r["id"], r["note"]) for r in rows] == [("1", long), ("2", "b\nc"), ("3", "d")]


@pytest.mark.parametrize("body", ['1,5" pipe\n2,"b\nc"\n', '1,"b\nc"\n2,"open\n3,d\n'])
def test_quotes_that_need_the_whole_file(spark, tmp_path, body):
    file = tmp_path / "t.csv"
    file.write_text("id,note\n" + body)
    assert text_tables._records(spark, str(file), "utf-8") is None
    whole = spark.read.csv(str(file), header=True, multiLine=True, quote='"', escape='"').collect()
    assert [[r["id"], r["note"]] for r in read_text_table(spark, str(file)).collect()] == [list(r) for r in whole]


def test_surplus_cells_still_fail(spark, tmp_path):
    file = tmp_path / "t.csv"
    file.write_text('id,note\n1,"b\nc",too many\n')
    with pytest.raises(Exception, match="more cells than headers"):
        read_text_table(spark, str(file)).collect()
