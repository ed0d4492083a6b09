import json
import time

from pyspark.sql import functions as F

from textwerk.sources import readers, writers
from textwerk.streaming import ingest


def test_csv_with_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"a\nb ""c"""\n2,d\n')
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv")).orderBy("id").collect()] == [("1", 'a\nb "c"'), ("2", "d")]


def test_ragged(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1;x\n2\n\n3;y;z\n")
    assert sorted(map(tuple, readers.read_ragged(spark, str(tmp_path / "a.txt"), ";", 2).collect()), key=str) == [("1", "x"), ("2", None)]


def test_jsonl_and_append(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text":"a","label":"human"}\n\n{"text":"b","label":1,"source":"s"}\n{"text":"c","label":"x"}\n')
    df = readers.read_jsonl(spark, str(tmp_path / "a.jsonl"))
    assert sorted(map(tuple, df.collect())) == [("a", 0, "unknown"), ("b", 1, "s")]
    out = str(tmp_path / "out")
    assert writers.append_new(df, out).count() == 2 and writers.append_new(df, out).count() == 0


def test_encoding_and_text(spark, tmp_path):
    (tmp_path / "l.txt").write_bytes("Größe\n".encode("latin-1"))
    assert readers.read_with_fallback(spark, str(tmp_path / "l.txt")).first().value == "Größe"
    assert readers.read_text_file(spark, str(tmp_path / "l.txt")).count() == 1


def test_html(spark):
    words = " ".join(["wort"] * 31)
    df = spark.createDataFrame([(1, f"<p class='x'>{words} &amp; <b>fett</b>[3]</p><p>kurz</p>")], "id long, html string")
    assert [r.text for r in readers.html_paragraphs(df, "id", "html").collect()] == [words + " & fett"]


def test_reports_and_threshold(spark, tmp_path):
    writers.write_report({"a": spark.range(2)}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": [{"id": 0}, {"id": 1}]} and "| id |" in (tmp_path / "r.md").read_text()
    writers.write_threshold(0.18, str(tmp_path / "t"))
    assert writers.read_threshold(str(tmp_path / "t")) == 0.18 and writers.read_threshold(str(tmp_path / "none"), 0.3) == 0.3
    writers.write_splits(spark.range(4).withColumn("split", F.when(F.col("id") < 2, "a").otherwise("b")), str(tmp_path / "s"))
    assert sorted(p.name for p in (tmp_path / "s").glob("split=*")) == ["split=a", "split=b"]
    assert readers.autodetect_column(spark.range(1).toDF("Text"), ["body", "text"]) == "Text"


def test_stream_deduplicates(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    text = "Die schöne Straße führt durch den alten Wald und über den kleinen Fluss hinaus."
    (src / "1.json").write_text("\n".join(json.dumps({"text": t, "label": 0, "source": "s", "loaded_at": "2024-01-01T00:00:00Z"}) for t in (text, text + "  ", "kurz")))
    q = ingest.clean_stream(spark, str(src)).writeStream.format("memory").queryName("cleaned").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    time.sleep(0.1)
    q.stop()
    assert spark.table("cleaned").count() == 1
