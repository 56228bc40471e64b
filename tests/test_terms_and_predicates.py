import datetime as dt
import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lakelog.functions.predicates import row_predicate, searchable_columns, term_predicate, window_predicate
from lakelog.functions.terms import Term


def hits(df, words, cond="OR", case_sensitive=False):
    predicate = row_predicate(df.schema.fields, [Term.read(w) for w in words], cond, case_sensitive)
    return None if predicate is None else [r[0] for r in df.where(predicate).orderBy(df.columns[0]).collect()]


@pytest.mark.parametrize(
    "text, number",
    [("42", 42), ("1_000", 1000), (" 42 ", 42), ("1e3", 1000.0), ("-0.5", -0.5), ("x", None), ("", None)],
)
def test_numbers_read_as_python_reads_them(text, number):
    assert Term.read(text).number == number


def test_special_and_huge_numbers():
    assert math.isnan(Term.read("nan").number) and Term.read("inf").number == math.inf
    assert Term.read(str(2**63)).number == Decimal(2**63)
    assert Term.read("9" * 39).number is None


def test_days_and_truth():
    assert Term.read("2024-1-5").day == dt.date(2024, 1, 5)
    assert Term.read("2024-13-01").day is None and Term.read("20240105").day is None
    assert Term.read("TRUE").truth is True and Term.read("false").truth is False and Term.read("1").truth is None


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.sql(
        """select * from values
        (1, 'Alpha 42', 42L, 0.5D, 1.10BD, date'2024-01-01', timestamp'2024-01-01 10:00:00', timestamp_ntz'2024-01-01 23:59:59.999999', true, array(42)),
        (2, 'beta', 7L, 42D, 42.00BD, date'2024-01-02', timestamp'2024-01-03 00:00:00', timestamp_ntz'2024-01-02 00:00:00', false, array(1)),
        (3, null, null, null, null, null, null, null, null, null),
        (4, 'ÉTÉ true', 0L, double('nan'), 0BD, date'2024-02-01', timestamp'2024-02-01 00:00:00', timestamp_ntz'2024-02-01 00:00:00', true, array(9))
        as t(id, s, l, d, dec, day, ts, ntz, flag, arr)"""
    )


def test_strings_match_inside_and_ignore_case_unless_told(mixed):
    assert hits(mixed.select("id", "s"), ["ALPHA"]) == [1]
    assert hits(mixed.select("id", "s"), ["ALPHA"], case_sensitive=True) == []
    assert hits(mixed.select("id", "s"), ["été"]) == [4]
    assert hits(mixed.select("id", "s"), [""]) == [1, 2, 4]


def test_numbers_match_exactly_in_every_numeric_type(mixed):
    assert hits(mixed.select("id", "l", "d", "dec"), ["42"]) == [1, 2]
    assert hits(mixed.select("id", "dec"), ["1.1"]) == [1]
    assert hits(mixed.select("id", "d"), ["nan"]) == [4]
    assert hits(mixed.select("id", "l"), ["7.5"]) == []
    assert hits(mixed.select("id", "l"), [str(2**70)]) == []


def test_float_column_does_not_equal_the_double_it_was_rounded_from(spark):
    df = spark.sql("select 1 as id, float(0.1) as f")
    assert hits(df, ["0.1"]) == []


def test_days_match_dates_and_both_timestamp_types(mixed):
    assert hits(mixed.select("id", "day"), ["2024-01-02"]) == [2]
    assert hits(mixed.select("id", "ts"), ["2024-01-01"]) == [1]
    assert hits(mixed.select("id", "ntz"), ["2024-1-1"]) == [1]


def test_booleans_match_their_words(mixed):
    assert hits(mixed.select("id", "flag"), ["False"]) == [2]
    assert term_predicate(mixed.schema["flag"], Term.read("yes")) is None


def test_types_without_a_reading_are_left_out(mixed):
    terms = [Term.read("42"), Term.read("x")]
    assert searchable_columns(mixed.schema.fields, terms) == ["id", "s", "l", "d", "dec"]
    assert row_predicate([mixed.schema["arr"]], terms) is None
    assert row_predicate(mixed.schema.fields, []) is None


def test_and_needs_every_term_somewhere(mixed):
    assert hits(mixed, ["alpha", "2024-01-01"], "AND") == [1]
    assert hits(mixed, ["alpha", "2024-01-02"], "and") == []
    assert hits(mixed.select("id", "l"), ["42", "word"], "AND") == []


def test_and_with_a_term_no_column_holds_reads_nothing(mixed):
    predicate = row_predicate([mixed.schema["l"]], [Term.read("word")], "AND")
    plan = mixed.select("l").where(predicate)._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation <empty>" in plan


def test_unknown_fold_word_is_an_error(mixed):
    with pytest.raises(ValueError, match="AND or OR"):
        row_predicate(mixed.schema.fields, [], "XOR")


def test_odd_column_names(spark):
    df = spark.sql("select 'x1' as `a.b`, 'x2' as `c d`, 'x3' as `e``f`")
    for word in ("x1", "x2", "x3"):
        assert df.where(row_predicate(df.schema.fields, [Term.read(word)])).count() == 1


def test_many_terms_on_a_wide_table(spark):
    wide = spark.range(3).select(*[F.col("id").alias(f"c{i}") for i in range(200)])
    assert hits(wide, [str(n) for n in range(1, 30)]) == [1, 2]


def test_several_terms_agree_with_one_at_a_time(mixed):
    words = ["42", "beta", "été", "nan", "1.1", "2024-02-01", "TRUE", str(2**70), "7", "0", ""]
    singles = {w: set(hits(mixed, [w])) for w in words}
    for size in (2, 3, len(words)):
        for start in range(len(words)):
            some = [words[(start + i) % len(words)] for i in range(size)]
            assert set(hits(mixed, some)) == set().union(*[singles[w] for w in some]), some
            assert set(hits(mixed, some, "AND")) == set.intersection(*[singles[w] for w in some]), some


def test_whole_numbers_of_an_or_become_one_list(spark):
    df = spark.range(100)
    plan = df.where(row_predicate(df.schema.fields, [Term.read(w) for w in ("3", "5", "7.5")]))._jdf.queryExecution()
    assert "IN (3,5)" in plan.optimizedPlan().toString()


def window(df, column, start, end):
    predicate = window_predicate(df.schema.fields, column, (start, end))
    return None if predicate is None else [r[0] for r in df.where(predicate).orderBy("id").collect()]


@pytest.mark.parametrize("column", ["day", "ts", "ntz"])
def test_window_includes_the_whole_end_day(mixed, column):
    assert window(mixed, column, "2024-01-01", "2024-01-01") == [1]
    assert window(mixed, column, "2024-01-02", "") == [2, 4]
    assert window(mixed, column, "", "2024-01-31") == [1, 2]


def test_window_start_may_carry_a_time(mixed):
    assert window(mixed, "ntz", "2024-01-01 23:59:59", "") == [1, 2, 4]
    assert window(mixed, "day", "2024-01-01 00:00:01", "") == [2, 4]


def test_window_without_column_or_bounds_passes_all(mixed):
    assert window(mixed, "ingested_at", "2024-01-01", "2024-01-02") is None
    assert window(mixed, "ts", "", "") is None


def test_window_on_text_is_lexicographic_and_on_numbers_an_error(mixed, spark):
    texts = spark.sql("select * from values (1, '2024-01-01T10'), (2, '2024-01-02') as t(id, at)")
    assert window(texts, "at", "2024-01-01", "2024-01-01") == [1]
    with pytest.raises(ValueError, match="'l'"):
        window(mixed, "l", "2024-01-01", "")


def test_bad_bounds_are_errors(mixed):
    with pytest.raises(ValueError, match="YYYY-MM-DD"):
        window(mixed, "ts", "", "soon")
    with pytest.raises(ValueError, match="ISO"):
        window(mixed, "ts", "soon", "")


def _executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("cond", ["OR", "AND"])
def test_terms_are_compared_in_generated_code(spark, cond):
    """Two terms of any kind with either word, and any number of terms with AND: no array function in the plan."""
    frame = spark.range(3).select("id", F.lit("text").alias("a"), F.lit("more").alias("b"), F.current_timestamp().alias("t"))
    frame = frame.union(frame)  # not a local relation
    words = ("error", "2024-01-15") if cond == "OR" else ("error", "2024-01-15", "42", "x", "y")
    plan = _executed(frame.where(row_predicate(frame.schema.fields, [Term.read(w) for w in words], cond)))
    assert "exists(" not in plan and "lambda" not in plan


def test_many_terms_find_what_single_terms_find(spark):
    texts = ["Alpha beta", "GAMMA", None, "", "delta ALPHA gamma", "İstanbul", "a%b_c", "x\\y"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, s string")
    words = ["alpha", "gamma", "delta", "a%b", "\\", "beta", "nowhere", "b_c"]
    for n in (1, 2, 3, 8):
        terms = [Term.read(w) for w in words[:n]]
        held = [{r["id"] for r in frame.where(row_predicate(frame.schema.fields, [t])).collect()} for t in terms]
        found = {r["id"] for r in frame.where(row_predicate(frame.schema.fields, terms, "OR")).collect()}
        assert found == set.union(*held)
        every = {r["id"] for r in frame.where(row_predicate(frame.schema.fields, terms, "AND")).collect()}
        assert every == set.intersection(*held)
