"""CSV rules, encodings, row numbers and sinks."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import queries
from gaugework.sources import files, mess, records
from gaugework.sources.files import CsvFormat


def write(tmp_path, *parts, encoding="utf-8"):
    folder = tmp_path / "data.csv"
    folder.mkdir()
    for i, text in enumerate(parts):
        (folder / f"part-{i}.csv").write_bytes(text.encode(encoding))
    return str(folder)


def test_separator(spark, tmp_path):
    assert files.sniff_separator(spark, write(tmp_path, "a;b;c\n1,5;2;3\n")) == ";"


def test_null_tokens_and_storage(spark, tmp_path):
    path = write(tmp_path, "i,d,b,s,e,m,t\n1,1.5,true,x,,10,2020-01-01\n2,N/A,false,null,NA,TBD,2020-01-02\n,3,true,y,nan,30,2020-01-03\n")
    df = files.load_table(spark, path)
    assert {f.name: f.dataType.simpleString() for f in df.schema} == {
        "i": "bigint", "d": "double", "b": "boolean", "s": "string", "e": "double", "m": "string", "t": "string",
    }
    assert [r["d"] for r in df.collect()] == [1.5, None, 3.0]
    assert df.filter("s IS NULL").count() == 1


def test_long_lines_go_short_lines_stay(spark, tmp_path):
    path = write(tmp_path, 'a,b,c\n1,2,3\n4,5\n6,7,8,9\n1,2,3,\n"x,y",2,3\n')
    form = files.csv_format(spark, path)
    table = files.read_csv_text(spark, path, form)
    assert table.count() == 3
    assert {(r["a"], r["c"]) for r in table.collect()} == {("1", "3"), ("4", None), ("x,y", "3")}
    assert files.bad_lines(spark, path, form).count() == 2


def test_windows_1252(spark, tmp_path):
    path = write(tmp_path, "a,b\ncafé,5 €\n“x”,y\n", encoding="cp1252")
    assert files.sniff_encoding(spark, path) == "windows-1252"
    rows = files.read_csv(spark, path).collect()
    assert {(r["a"], r["b"]) for r in rows} == {("café", "5 €"), ("“x”", "y")}


def test_utf8_needs_every_line(spark, tmp_path):
    lines = "a\n" + "x\n" * 5000 + "é\n"
    folder = tmp_path / "late"
    folder.mkdir()
    (folder / "p.csv").write_bytes(lines.encode("cp1252"))
    assert files.sniff_encoding(spark, str(folder)) == "windows-1252"


def test_row_numbers_follow_the_file(spark, tmp_path):
    path = write(tmp_path, "a\n" + "".join(f"{i}\n" for i in range(50)), "a\n" + "".join(f"{i}\n" for i in range(50, 60)))
    df = files.read_csv(spark, path, row_ids=True)
    assert [(r["_row_id"], r["a"]) for r in df.orderBy("_row_id").collect()] == [(i, i) for i in range(60)]


def test_unknown_suffix(spark):
    with pytest.raises(ValueError, match="Unsupported file type"):
        files.load_table(spark, "table.json")


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, 'say "hi", now', 1.5), (1, " padded ", None)], "_row_id bigint, s string, x double")
    path = files.write_csv(df, str(tmp_path / files.cleaned_name("in.csv")))
    assert path.endswith("in_cleaned.csv")
    back = files.load_table(spark, path)
    assert back.columns == ["s", "x"]
    assert {(r["s"], r["x"]) for r in back.collect()} == {('say "hi", now', 1.5), (" padded ", None)}


def test_guards(spark):
    row = files.input_guards(spark.range(0).toDF("x")).first()
    assert row["is_empty"] and not row["is_large"]
    assert files.input_guards(spark.range(100_001).toDF("x")).first()["is_large"]


def test_mess_is_repeatable(spark):
    df = spark.range(1000).selectExpr("id", "'Yes' AS flag", "cast(id AS double) AS x")
    rules = [mess.gaps("x", mess.about("id", 0.2, seed=3)), *mess.boolean_spellings("flag", "id", ["yes", "N"])]
    copies = [mess.Copies(mess.every("id", 100, 0), offset=10_000)]
    one = mess.inject_mess(df, "id", rules, copies)
    two = mess.inject_mess(df.repartition(7), "id", rules, copies)
    assert one.count() == 1010
    assert one.exceptAll(two).count() == 0
    assert 120 < one.filter("x IS NULL").count() < 280
    assert mess.inject_mess(df, "id").exceptAll(df).count() == 0


def test_format_dataclass():
    assert CsvFormat(",", "UTF-8", ["a"]).separator == ","


BREAKS = 'k,t,x\n1,"a\nb, ""c""\n\n",u\n2,plain,v\n\n3,"5"" wide",w\n4,5" tall,w\n5,"last\r\nline",z\n'


@pytest.mark.parametrize("size", [40, 90])
def test_quoted_line_breaks_in_splits_of_any_size(spark, tmp_path, size):
    """Records over the borders of many splits of one file, next to a file without line breaks."""
    path = write(tmp_path, BREAKS + "".join(f'{i},"{"p" * (i % 9)}\n{"q" * (i % 5)}",{i}\r\n' for i in range(6, 20)), "k,t,x\n70,a,b\n")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        form = files.csv_format(spark, path)
        assert [f.rsplit("/", 1)[-1] for f in form.broken] == ["part-0.csv"]
        rows = files.read_csv_text(spark, path, form).collect()
        numbered = files.read_csv(spark, path, row_ids=True).collect()
    finally:
        spark.conf.set(key, before)
    expected = [
        ("1", 'a\nb, "c"\n\n', "u"), ("2", "plain", "v"), ("3", '5" wide', "w"), ("4", '5" tall', "w"), ("5", "last\r\nline", "z"),
        *[(str(i), f"{'p' * (i % 9)}\n{'q' * (i % 5)}", str(i)) for i in range(6, 20)], ("70", "a", "b"),
    ]
    assert sorted(map(tuple, rows), key=lambda r: int(r[0])) == expected
    assert [r["k"] for r in sorted(numbered, key=lambda r: r["_row_id"])] == [int(r[0]) for r in expected]
    assert sorted(r["_row_id"] for r in numbered) == list(range(len(expected)))


def test_bad_records_run_over_lines(spark, tmp_path):
    path = write(tmp_path, 'a,b\n"x\ny",2\n"x,\ny",2,3\n4,5,"\n"\n6\n')
    form = files.csv_format(spark, path)
    assert sorted(r["line"] for r in files.bad_lines(spark, path, form).collect()) == ['"x,\ny",2,3', '4,5,"\n"']
    assert sorted(map(tuple, files.read_csv_text(spark, path, form).collect()), key=str) == [("6", None), ("x\ny", "2")]


def test_line_breaks_in_windows_1252_and_open_quotes(spark, tmp_path):
    path = write(tmp_path, 'a;b\n"é\n“";1\n"never closed;2\n', encoding="cp1252")
    rows = files.read_csv(spark, path).collect()
    assert {(r["a"] or "").strip('"\n') for r in rows} == {"é\n“", "never closed;2"}


def test_states_of_lines_agree_with_reading_every_character():
    def slow(lines, inside):
        states, state = [inside], "q" if inside else "s"
        for line in lines:
            for c in line:
                if c == '"':
                    state = {"s": "q", "m": "m", "q": "c", "c": "q"}[state]
                elif state != "q":
                    state = "s" if c == "," else "m"
            state = "q" if state == "q" else "s"
            states.append(int(state == "q"))
        return states

    draw = random.Random(4)
    for _ in range(400):
        lines = ["".join(draw.choices('",a', [3, 2, 2], k=draw.randint(0, 7))) for _ in range(draw.randint(0, 6))]
        data = np.frombuffer("".join(lines).encode(), np.uint8)
        offsets = np.cumsum([0, *map(len, lines)])
        for inside in (0, 1):
            assert records.line_states(data, offsets, b",", inside).tolist() == slow(lines, inside), lines


@pytest.mark.parametrize("size, least", [(30_000, 3), (1 << 40, 1)])
def test_texts_of_many_bytes_do_not_go_through_one_task(spark, sf, monkeypatch, size, least):
    """One file for a small table; beyond that no file, and so no task, takes much more than its share."""
    monkeypatch.setattr(files, "FILE_BYTES", size, raising=False)
    write, written = files.write_csv, []
    monkeypatch.setattr(files, "write_csv", lambda df, path: written.append(path) or write(df, path))
    found = {r["doc_id"]: r["text_sha256"] for r in queries.csv_single_file(spark, sf).collect()}
    texts = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "sha2(text, 256)", "octet_length(text)").collect()
    assert found == {r[0]: r[1] for r in texts}
    sizes = [f.stat().st_size for f in Path(written[0]).glob("part-*")]
    assert len(sizes) == max(1, -(-sum(r[2] or 0 for r in texts) // size)) >= least
    assert size > 1 << 30 or max(sizes) < 3 * size, sizes


def test_large_files_keep_all_rows(spark, monkeypatch):
    monkeypatch.setattr(files, "FILE_BYTES", 100)
    for rows, parts, count in ((0, 4, 1), (40, 20, 4), (40, 1, 4), (9, 3, 1)):
        frame = spark.range(0, rows, 1, parts).select("id", F.when(F.col("id") != 5, 10).alias("size"))
        large = files.in_large_files(frame, F.col("size"))
        assert large.rdd.getNumPartitions() == count
        assert sorted(r["id"] for r in large.collect()) == list(range(rows))


def test_one_big_file_is_read_by_several_tasks(spark, tmp_path):
    texts = [f'line {i}\n"quoted", {"x" * 200}\nlast' for i in range(3000)]
    frame = spark.createDataFrame(list(enumerate(texts)), "k long, t string").coalesce(1)
    path = files.write_csv(frame, str(tmp_path / "big.csv"))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, 200_000)
    try:
        form = files.csv_format(spark, path)
        found = files._placed_records(spark, path, form)
        assert len(form.broken) == 1 and found.select("_start").distinct().count() > 3
        assert {r["k"]: r["t"] for r in found.collect()} == {str(i): t for i, t in enumerate(texts)}
    finally:
        spark.conf.set(key, before)
