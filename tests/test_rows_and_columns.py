import pytest
from pyspark.sql import functions as F

from facets.functions.numeric import with_calendar, with_helpfulness
from facets.functions.text import with_category, with_clean_text, with_lengths
from facets.operators import features, profile, rows, temporal
from facets.sources import reviews as sources


def test_csv_missing_marks(spark, tmp_path):
    (tmp_path / "r.csv").write_text(
        'Id,Text,Summary\n1,"say ""hi"", ok\nline2",NA\n2,b,\n3,c,None\n4,d,none\n')
    got = {r["Id"]: r for r in sources.read_reviews(spark, str(tmp_path / "r.csv")).collect()}
    assert len(got) == 4
    assert got[1]["Text"] == 'say "hi", ok\nline2'
    assert [got[i]["Summary"] for i in (1, 2, 3, 4)] == [None, None, None, "none"]


def test_write_tables(spark, tmp_path):
    sources.write_tables({"a": spark.range(3), "b": spark.range(5)}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/b").count() == 5
    sources.write_assigned(spark.range(4), f"{tmp_path}/assigned")
    assert spark.read.parquet(f"{tmp_path}/assigned").count() == 4


def test_dedup_before_null_drop(spark):
    df = spark.createDataFrame(
        [(1, "a", 1, "q", None), (2, "a", 1, "q", "S"), (3, "b", 2, "z", "S"),
         (4, "b", 2, "z", "T"), (5, None, 3, "w", "S"), (6, None, 3, "w", "S")],
        "Id long, UserId string, Time long, Text string, Summary string")
    kept = rows.drop_missing(rows.dedup_keep_first(df, ["UserId", "Time", "Text"]))
    assert sorted(r["Id"] for r in kept.collect()) == [3, 5]


def test_clean_text_example(spark):
    df = spark.createDataFrame(
        [(1, "Great <b>Tea</b>!", "See http://x.co/a?b now.  It's 5 stars", 1, 1)],
        "Id long, Summary string, Text string, HelpfulnessNumerator int, "
        "HelpfulnessDenominator int")
    r = with_helpfulness(with_lengths(with_clean_text(df))).first()
    assert r["clean_text"] == "great tea see now it s stars"
    assert (r["word_count"], r["summary_length"], r["helpfulness_ratio"]) == (6, 17, 0.5)


@pytest.mark.parametrize("text,count", [
    ("", 0), (" ", 0), ("a", 1), (" a ", 1), ("a b", 2), ("a\x1cb", 2), ("a \n\t b", 2)])
def test_word_count_follows_unicode_blanks(spark, text, count):
    df = spark.createDataFrame([(text, "s")], "Text string, Summary string")
    assert with_lengths(df).first()["word_count"] == count


def test_link_ends_at_a_unicode_blank(spark):
    df = spark.createDataFrame([("see http://a.b now", None)], "Text string, Summary string")
    assert with_clean_text(df).first()["clean_text"] == "see now"


@pytest.mark.parametrize("summary,category", [
    ("Steak sauce", "Coffee & Tea"), ("Minute rice", "Nuts & Snacks"),
    ("Boiled eggs", "Condiments & Sauces"), ("Dog bowl", "Pet Food"),
    ("Fresh eggs", "General Grocery")])
def test_category_rules(spark, summary, category):
    df = spark.createDataFrame([(summary, "")], "Summary string, Text string")
    assert with_category(df).first()["category"] == category


def test_calendar_ignores_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        r = with_calendar(spark.createDataFrame([(946684799,)], "Time long")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert (r["Year"], r["Month"], r["Quarter"]) == (1999, 12, 4)


def test_keep_frequent_boundary(spark):
    df = spark.createDataFrame([(1999,)] * 29 + [(2000,)] * 30, "Year int")
    assert [r[0] for r in rows.keep_frequent(df, "Year", 30).distinct().collect()] == [2000]


def test_months_are_filled(spark):
    df = spark.createDataFrame([(0, 1, 2), (0, 1, 12), (1, 5, 3)],
                               "cluster int, Score int, Month int")
    got = {r["Month"]: r for r in temporal.monthly_volume(df).collect()}
    assert len(got) == 12 and sum(r["n"] == 0 for r in got.values()) == 10
    assert [m for m in sorted(got) if got[m]["is_holiday"]] == [1, 11, 12]


def test_standardize(spark):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (3.0, 7.0)], "a double, b double")
    got = features.standardize(df, ["a", "b"]).orderBy("a").collect()
    assert [r["a_std"] for r in got] == pytest.approx([-1.224744871391589, 0, 1.224744871391589])
    assert [r["b_std"] for r in got] == [0, 0, 0]


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_samples_do_not_depend_on_partitions(spark, parts):
    df = spark.range(5000).withColumn("g", F.col("id") % 3).repartition(parts)
    few = rows.sample_exact(df, 100, key="id")
    assert few.agg(F.count("*"), F.sum("id")).first() == \
        rows.sample_exact(df.coalesce(1), 100, key="id").agg(F.count("*"), F.sum("id")).first()
    assert rows.sample_exact(df, 9999, key="id").count() == 5000
    small = rows.sample_per_group(df, "g", 1200, key="id")
    plain = df.withColumn("d", rows.draw("id", 42))
    expected = set()
    for g in range(3):
        expected |= {r["id"] for r in plain.where(F.col("g") == g).orderBy("d").limit(1200).collect()}
    assert {r["id"] for r in small.collect()} == expected


def test_index_is_total(spark):
    df = spark.range(1000).withColumn("v", (F.col("id") % 3) * 0)
    got = rows.with_index(df.repartition(7), F.col("v"), F.col("id")).orderBy("idx").collect()
    assert [r["idx"] for r in got] == list(range(1000))
    assert [r["id"] for r in got] == list(range(1000))


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([(0.125, 1)], "a double, n int")
    assert profile.rounded(df).first()["a"] == 0.12


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(3.0,)] * 4, "v double")
    got = profile.histogram(df, "v", 4).orderBy("bin").collect()
    assert [r["n"] for r in got] == [0, 0, 4, 0]


def test_lines_that_end_inside_quotes():
    from facets.sources.csv import line_ends_inside
    outside = {"": False, "a,b": False, '"a': True, '"a"': False, 'a"b': False, 'a,"b""': True,
               'a,"b"",c': True, '"a"x",b': False, ',"': True, '"a","b': True, ' "a': False}
    inside = {"": True, "a,b": True, 'a"': False, 'a"",b': True, 'a","b': True, 'a"b,"c"': False,
              '"",""': True, '"': False}
    assert {t: line_ends_inside(t, False) for t in outside} == outside
    assert {t: line_ends_inside(t, True) for t in inside} == inside


@pytest.mark.parametrize("size", [1 << 20, 37, 11])
def test_csv_files_cut_into_ranges(spark, tmp_path, size):
    """Whatever the ranges are, the records are those of the reader that takes files whole."""
    import random

    from facets.sources.csv import read_csv
    draw = random.Random(5)

    def field():
        body = "".join(draw.choice("ab é,x\"\n") for _ in range(draw.randint(0, 6)))
        if draw.random() < 0.55:
            return '"' + body.replace('"', '""') + '"'
        return body.replace(",", "").replace('"', "").replace("\n", "") + draw.choice(["", 'z"'])

    for f, end in enumerate(("\n", "\r\n")):
        lines = ['Id,"the ""Text""",c'] + [f"{f}{i},{field()},{field()}" for i in range(12)]
        (tmp_path / f"{f}.csv").write_text(end.join(lines) + end, newline="")
    path = str(tmp_path)
    whole = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    want = sorted(map(repr, whole.collect()))
    settings = {"spark.sql.files.maxPartitionBytes": str(size),
                "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = read_csv(spark, path)
        assert found.columns == whole.columns
        got = sorted(map(repr, found.collect()))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == want and len(want) == 24
