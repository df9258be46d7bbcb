"""The SQL functions give what the column functions of the same names give."""

import pytest
from pyspark.sql import functions as F

from dosewise import lexicons as L
from dosewise.functions import rules as R
from dosewise.functions import sql as S
from dosewise.functions import text as T

TEXTS = [
    None,
    "",
    "   ",
    "one two",
    " word word word\n" * 12,
    "I understand how you feel and I care about your feelings; the goal is to win the game with the best strategy " * 2,
    "it's a \\ 'quoted' | table",
    "{ \"a\": { \"b\": 1 } }",
    "x\n ---- \ny",
    "the rules are: step 1 move to the grid cell, step 2 next action, players score points in the game",
    "step one then the grid coordinates",
    "help support care safety " * 40,
    "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 4,
]

def of_text():
    return {
        "text_words(text)": T.words(F.col("text")),
        "text_strip(text)": T.strip(F.col("text")),
        "word_count(text)": T.word_count(F.col("text")),
        "distinct_word_share(text)": T.distinct_word_share(F.col("text")),
        "is_coherent(text)": T.is_coherent(F.col("text")),
        "is_coherent(text, min_words => 2, min_length => 5)": T.is_coherent(F.col("text"), min_words=2, min_length=5),
        "is_repetitive(text)": T.is_repetitive(F.col("text")),
        "is_repetitive(text, 0.9)": T.is_repetitive(F.col("text"), 0.9),
        "is_coherent_loose(text)": T.is_coherent_loose(F.col("text")),
        "keyword_hits(text, array('word', 'it\\'s', '\\\\', 'game'))": T.keyword_hits(F.col("text"), ["word", "it's", "\\", "game"]),
        "any_term(text, array('word', 'game'))": T.any_term(F.col("text"), ["word", "game"]),
        "lexical_majority(text)": T.lexical_majority(F.col("text")),
        "lexical_majority(text, array('care'), array('win'))": T.lexical_majority(F.col("text"), ["care"], ["win"]),
        "lexical_majority3(text)": T.lexical_majority3(F.col("text")),
        "lexical_ratio(text)": T.lexical_ratio(F.col("text")),
        "lexical_ratio(text, min_length => 0)": T.lexical_ratio(F.col("text"), min_length=0),
        "detect_format(text)": T.detect_format(F.col("text")),
        "strip_prompt(text, 'one')": T.strip_prompt(F.col("text"), F.lit("one")),
        "preview(text, 4)": T.preview(F.col("text"), 4),
        **{f"text_flags(text)['{k}']": T.flags(F.col("text"))[k] for k in L.FLAG_TERMS},
    }


def of_number():
    return {
        "condition_name(x)": R.condition_name(F.col("x")),
        "condition_name(x, false)": R.condition_name(F.col("x"), negative_branch=False),
        "drop_verdict(x)": R.drop_verdict(F.col("x")),
        "variance_verdict(x)": R.variance_verdict(F.col("x")),
        "auroc_target(x)": R.auroc_target(F.col("x")),
        "auroc_target(x, target => 0.3)": R.auroc_target(F.col("x"), 0.3),
        "correlation_target(x)": R.correlation_target(F.col("x")),
        "correlation_target(x, absolute => false)": R.correlation_target(F.col("x"), absolute=False),
        "three_decimals(x)": R.three_decimals(F.col("x")),
        "percent(x)": R.percent(F.col("x")),
        "rating_category(int(x))": R.rating_category(F.col("x").cast("int")),
        "rating_extremes(int(x))": R.rating_extremes(F.col("x").cast("int")),
        "rating_at_least_one(int(x))": R.rating_at_least_one(F.col("x").cast("int")),
    }


@pytest.fixture(scope="module")
def registered(spark):
    return S.register_functions(spark)


def same(df, pairs):
    df = df.select("*", *[c.alias(f"c{k}") for k, c in enumerate(pairs.values())], *[F.expr(e).alias(f"s{k}") for k, e in enumerate(pairs)])
    for row in df.collect():
        for k, e in enumerate(pairs):
            assert row[f"c{k}"] == row[f"s{k}"], (e, row[0], row[f"c{k}"], row[f"s{k}"])


def test_text_functions(spark, registered):
    same(spark.createDataFrame([(t,) for t in TEXTS], "text string"), of_text())


def test_number_functions(spark, registered):
    numbers = [None, 0.0, -20.0, -0.5, 0.1, 0.15, 0.3, 0.35, 0.4, 0.5, 0.75, 1.0, 2.0, 3.0, 4.0, 5.0, 10.0, 20.0]
    same(spark.createDataFrame([(x,) for x in numbers], "x double"), of_number())


def test_markers(spark, registered):
    scenarios = [*L.SCENARIO_MARKERS, "unknown", None]
    rows = [(" ".join(terms[:n]), s) for terms in L.SCENARIO_MARKERS.values() for n in (0, 1, 2) for s in scenarios]
    df = spark.createDataFrame([*rows, (None, scenarios[0])], "text string, scenario string")
    same(df, {"contains_markers(text, scenario)": T.contains_markers(F.col("text"), F.col("scenario"))})


def test_all_are_registered_and_again(spark, registered):
    assert S.register_functions(spark) == registered and len(set(registered)) == len(S.FUNCTIONS)
    used = {e.split("(")[0] for e in (*of_text(), *of_number())} | {"contains_markers"}
    assert used == set(registered)


def test_plan_has_no_python(spark, registered):
    spark.createDataFrame([("a",)], "text string").createOrReplaceTempView("sql_function_texts")
    plan = spark.sql("SELECT lexical_ratio(text), detect_format(text) FROM sql_function_texts")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
