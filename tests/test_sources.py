from __future__ import annotations

import pytest

from plaudit.operators.labels import check_texts, load_audit, normalise_labels
from plaudit.operators.splits import class_balance
from plaudit.session import local_session
from plaudit.sources import readers as rd
from plaudit.sources import writers as wr
from plaudit.streaming.drops import score_drops

EDGES = (
    "review_text,label\n"
    "plain,fake\n"
    "too,many,fields\n"
    "too,,fields\n"
    "few\n"
    '"quoted, comma and ""doubled"" quote",genuine\n'
    '"line\nbreak",genuine\n'
    "NA,fake\n"
    ",genuine\n"
    "back\\slash,fake\n"
)


@pytest.fixture
def edge_file(tmp_path):
    path = tmp_path / "in" / "edges.csv"
    path.parent.mkdir()
    path.write_text(EDGES)
    return path


def test_csv_edges(spark, edge_file):
    rows = [(r[0], r[1]) for r in rd.read_csv(spark, str(edge_file)).collect()]
    assert rows == [
        ("plain", "fake"), ("few", None), ('quoted, comma and "doubled" quote', "genuine"), ("line\nbreak", "genuine"),
        (None, "fake"), (None, "genuine"), ("back\\slash", "fake"),
    ]


def test_labelled_load(spark, edge_file):
    data = rd.read_labelled(spark, str(edge_file))
    audit = load_audit(data).first().asDict()
    assert audit == {"rows": 4, "genuine": 2, "fake": 2, "bad_labels": 0, "missing": 0}
    assert sorted(r["label"] for r in normalise_labels(data).collect()) == [0, 0, 1, 1]


def test_fallback_and_columns(spark, tmp_path):
    other = spark.createDataFrame([("good one", "real")], "content string, class string")
    assert rd.read_labelled(spark, str(tmp_path / "none.csv"), other).first()["review_text"] == "good one"
    with pytest.raises(Exception):
        rd.read_labelled(spark, str(tmp_path / "none.csv"))
    assert rd.training_columns([" Text ", "IS_FAKE", "n"]) == (" Text ", "IS_FAKE")
    with pytest.raises(rd.SourceError, match="AMBIGUOUS"):
        rd.training_columns(["text", "review", "label"])
    with pytest.raises(rd.SourceError, match="MISSING"):
        rd.scoring_column([" text ", "x"])
    assert rd.scoring_column(["x", "Review", "text"]) == "Review"


def test_scoring_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,Text\n1,hello there\n2,\n3,NaN\n")
    (tmp_path / "b.txt").write_text("id,Text\n9,not read\n")
    assert [r["review_text"] for r in rd.read_scoring_csv(spark, str(tmp_path)).collect()] == ["hello there"]
    with pytest.raises(rd.SourceError, match="INVALID_FILE"):
        rd.read_scoring_csv(spark, str(tmp_path / "b.txt"))


def test_lines_and_lists(spark, tmp_path):
    (tmp_path / "r.txt").write_text("  one \n\n \nthree\n")
    rows = rd.read_lines(spark, str(tmp_path / "r.txt")).orderBy("review_id").collect()
    assert [r["review_text"] for r in rows] == ["one", "three"]
    listed = rd.from_texts(spark, [" a ", "", "b"])
    assert [(r[0], r[1]) for r in listed.orderBy("review_id").collect()] == [(0, "a"), (2, "b")]
    assert rd.guard_rows(listed, 2).count() == 2
    for most in (1,):
        with pytest.raises(rd.SourceError, match="INVALID_SIZE"):
            rd.guard_rows(listed, most)
    with pytest.raises(rd.SourceError):
        rd.guard_rows(rd.from_texts(spark, [" "]), 5)


def test_label_polarity(spark):
    df = spark.createDataFrame([("a b", "1"), ("c d", "genuine"), ("e f", "zero")], "review_text string, label string")
    assert sorted(r["label"] for r in normalise_labels(df).collect()) == [1, 1]
    assert sorted(r["label"] for r in normalise_labels(df, means="fake").collect()) == [0, 1]


def test_length_check(spark):
    df = rd.small_table(spark, {"review_id": range(4), "review_text": ["tiny", "fine text", "       ", "  abc "]})
    got = {r["review_id"]: (r["status"], r["length_ok_before_trim"]) for r in check_texts(df).collect()}
    assert got == {0: ("length", False), 1: ("valid", True), 2: ("blank", True), 3: ("valid", True)}


def test_single_class_is_balanced(spark):
    row = class_balance(spark.createDataFrame([(1,), (1,)], "label int")).first()
    assert row["minority_share"] == 1.0 and row["imbalanced"] is False


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c')], "review_id int, review_text string")
    wr.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').first()["review_text"] == 'a "b", c'
    for kind in ("json", "parquet", "orc"):
        wr.write_records(df, str(tmp_path / kind), kind)
        assert spark.read.format(kind).load(str(tmp_path / kind)).count() == 1
    with pytest.raises(ValueError):
        wr.write_records(df, str(tmp_path / "x"), "xml")


def test_stream_picks_up_new_files_only(spark, tmp_path):
    folder, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    folder.mkdir()

    def run():
        score_drops(spark, str(folder), ["review_text"], lambda df: df, str(out), str(mark))
        return sorted(r["review_text"] for r in spark.read.parquet(str(out)).collect())

    (folder / "a.csv").write_text("review_text\nfirst\n")
    assert run() == ["first"]
    (folder / "b.csv").write_text('review_text\n"second, with\nbreak"\n')
    assert run() == ["first", "second, with\nbreak"]
    assert run() == ["first", "second, with\nbreak"]


def test_shared_dir(spark):
    from plaudit.session import shared_dir

    assert shared_dir(spark)
    assert local_session() is not None


def test_files_with_other_headers_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,review_text\n1,first text\n")
    (tmp_path / "b.csv").write_text("review_text,id\nsecond text,2\n")
    with pytest.raises(Exception, match="header"):
        rd.read_csv(spark, str(tmp_path)).collect()


def test_empty_upload_is_rejected(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,review_text\n1,NaN\n2,\n")
    with pytest.raises(rd.SourceError, match="EMPTY_DATA"):
        rd.read_scoring_csv(spark, str(tmp_path / "a.csv"))


def test_stream_equals_batch_and_ids_differ(spark, tmp_path, edge_file):
    text = EDGES.replace("review_text,label", "review_text,other")
    folder, out, mark = tmp_path / "drops", str(tmp_path / "out"), str(tmp_path / "mark")
    folder.mkdir()
    (folder / "a.csv").write_text(text)
    score_drops(spark, str(folder), ["review_text", "other"], lambda df: df, out, mark)
    (folder / "b.csv").write_text(text)
    score_drops(spark, str(folder), ["review_text", "other"], lambda df: df, out, mark)
    rows = spark.read.parquet(out).collect()
    batch = [r["review_text"] for r in rd.read_scoring_csv(spark, str(folder)).collect()]
    assert sorted(r["review_text"] for r in rows) == sorted(batch)
    assert len({r["review_id"] for r in rows}) == len(rows) == 2 * 5
