import pytest
from pyspark.sql import functions as F

from textwerk.functions import rules as R
from textwerk.functions import text as T


def one(spark, text, make):
    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize(
    "text, want",
    [
        ("Nach § 18 Abs. 3 gilt dies.", "Nach [PARAGRAPH] gilt dies."),
        ("Artikel 5 und Absatz 4", "[PARAGRAPH] und [PARAGRAPH]"),
        ("am 15.06.2026 tagte die SPD .", "am [DATUM] tagte die [PARTEI]."),
        ("Drucksache 19/4820", "[DRUCKSACHE] [AZ]"),
        ("Az. 32/93721", "[AZ]"),
        ("in dieser 12. Plenarsitzung", "in dieser [[PLENARSITZUNG]]"),
        ("durch Uwe Schröder", "durch [PERSON]"),
        ("(Uwe Schröder)", "([PERSON])"),
    ],
)
def test_markers(spark, text, want):
    assert one(spark, text, lambda c: F.trim(R.apply_rules(c, R.MARKERS))) == want


def test_scalars(spark):
    assert one(spark, "a\n\n b\t c ", T.normalize_ws) == "a b c"
    assert one(spark, "a" * 1020 + " bcdefgh", T.truncate_chars) == "a" * 1020
    assert one(spark, "Aa. Bb! Cc? Dd", lambda c: F.size(T.sentences(c))) == 4
    assert one(spark, "2. Ausgangslage ist klar.", T.discard_sentences) == ""
    assert one(spark, "A. Gut so.", T.discard_sentences) == "Gut so."
    assert one(spark, "1234 ab", T.digit_ratio) == pytest.approx(4 / 7)
    assert one(spark, "", T.word_count) == 0 and one(spark, None, T.fingerprint) is None
    assert one(spark, "a b", T.trigram_set) == ["a b"]
    assert one(spark, "a b a b a b", T.trigram_set) == ["a b a", "b a b"]


@pytest.mark.parametrize("n, want", [(0, 1), (9, 1), (256, 1), (257, 2)])
def test_chunks(spark, n, want):
    assert len(one(spark, " ".join(["w"] * n), T.chunks)) == want


def test_chunks_are_windows(spark):
    got = one(spark, " ".join(map(str, range(300))), T.chunks)
    assert [c.split()[0] for c in got] == ["0", "128"] and got[1].split()[-1] == "299"


def test_groups(spark):
    ids = ["abc_seg3", "x__y", "gesetz_BGB_12", "eupdcorp_7_3", "19_Merkel_4", "foo", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(ids)], "k int, id string")
    got = [r.g for r in df.select("k", T.group_of_id(F.col("id")).alias("g")).orderBy("k").collect()]
    assert got == ["abc", "x", "gesetz_BGB", "eupdcorp_7", "19_Merkel", "foo", "unknown"]
