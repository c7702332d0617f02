"""Numbers of lines and CSV records over file splits, against one reader of whole files."""

import csv
import io
import random

import pytest

from tidemark.sources import feeds, lines


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_records_equal_one_reader_of_each_file(spark, tmp_path, small_splits):
    rng, want = random.Random(4), {}
    cells = ["", "a", 'say "x"', "two\nlines", "a,b", "\n\n", '"', " pad ", "é", "x" * 90]
    for f in range(3):
        out = io.StringIO()
        write = csv.writer(out, lineterminator="\n")
        write.writerow(["id", "note", "note"])
        for i in range(60):
            write.writerow([str(i), rng.choice(cells), rng.choice(cells)])
            if rng.random() < 0.2:
                out.write("\n")  # a blank line is no row
        (tmp_path / f"f{f}.csv").write_text(out.getvalue())
        rows = [r for r in csv.reader(io.StringIO(out.getvalue(), newline="")) if r]
        want |= {(f"f{f}.csv", i): tuple(r) for i, r in enumerate(rows[1:], 2)}
    found = lines.numbered_csv(spark, str(tmp_path))
    assert found.columns == ["id", "note", "note.1", "_file", "_row", "_payload"]
    got = {(r._file.rsplit("/", 1)[1], r._row): (r.id, r.note or "", r["note.1"] or "") for r in found.collect()}
    assert got == want
    text = lines.numbered_lines(spark, str(tmp_path)).collect()
    for f in range(3):
        assert [r.payload for r in sorted((r for r in text if r.file.endswith(f"f{f}.csv")), key=lambda r: r.row)] == (tmp_path / f"f{f}.csv").read_text().split("\n")[:-1]


def test_rejected_rows_say_where_they_stand(spark, tmp_path, small_splits):
    (tmp_path / "o.csv").write_text('Order_ID,customer,total,note\n1,c,3.5,"a\nb"\n\n,c,3,x\n3,c,much,"y\n"\n4,,1\n')
    good, bad = feeds.csv_upload(spark, str(tmp_path / "o.csv"), 1_700_000_000_000)
    assert [r.amount_cents for r in good.collect()] == [350]
    rows = sorted((r.row, r.error, r.payload) for r in bad.collect())
    assert rows == [(3, "No order_id", ",c,3,x"), (4, "Bad amount", '3,c,much,"y\n"'), (5, "No customer_id", "4,,1")]
    hooks = tmp_path / "h.jsonl"
    hooks.write_text('{"id": 1, "customer_id": 2, "created_at": 1700000000, "total_price": 2}\n{"id": 3}\nnot json\n')
    _, bad = feeds.webhook_files(spark, str(hooks), "shopify", 5)
    assert sorted((r.row, r.error, r.payload) for r in bad.collect()) == [(2, "Missing customer id", '{"id": 3}'), (3, "Missing 'id'", "not json")]


def test_files_that_are_no_table(spark, tmp_path):
    (tmp_path / "open.csv").write_text('a,b\n1,"x\n')
    with pytest.raises(ValueError, match="no end"):
        lines.numbered_csv(spark, str(tmp_path / "open.csv"))
    (tmp_path / "e.csv").write_text("")
    assert lines.numbered_csv(spark, str(tmp_path / "e.csv")).count() == 0
    (tmp_path / "d").mkdir()
    (tmp_path / "d/1.csv").write_text("a,b\n1,2\n")
    (tmp_path / "d/2.csv").write_text("a,c\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        lines.numbered_csv(spark, str(tmp_path / "d"))
