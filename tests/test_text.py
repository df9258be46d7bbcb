"""Text expressions on edge cases, against plain Python where that is the definition."""

import math

import pytest
from pyspark.sql import functions as F

from dosewise.functions import rules, text as T


def values(spark, texts, column, **extra):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r["x"] for r in df.withColumns(extra).orderBy("i").select(column.alias("x")).collect()]


TEXTS = [
    "",
    "   ",
    "one two  three\nfour",
    " lead wide　ideographic\x1cseparator trail\t",
    "ünï cödé ß",
    "a " * 9,
    "a b c " * 4,
    "x" * 49,
    "word " * 10 + "other end",
    "a b c d e f g h i j " * 3,
]


def test_words_split_like_unicode_aware_splitting(spark):
    assert values(spark, TEXTS, T.words(F.col("text"))) == [t.split() for t in TEXTS]
    assert values(spark, TEXTS, T.length(F.col("text"))) == [len(t) for t in TEXTS]
    assert values(spark, TEXTS, T.word_count(F.col("text"))) == [len(t.split()) for t in TEXTS]
    assert values(spark, TEXTS, T.strip(F.col("text"))) == [t.strip() for t in TEXTS]


def coherent(t, limit=50):
    w = t.split()
    return len(t) >= limit and len(w) >= 10 and len(set(w)) / len(w) >= 0.3


BORDER = [
    "aaaa bbbb cccc " + "cccc " * 7,  # 10 words, 3 distinct, 50 characters
    ("aaaa bbbb " + "bbbb " * 8),  # 10 words, 2 distinct
    ("aaaa bbbb cccc " + "cccc " * 7).strip(),  # 49 characters
    "abcdefghij klmnopqrst uvwxyzabcd efghijklmn opqrstuvw xyz a b c",  # 9 words
]


def test_coherence_borders(spark):
    texts = TEXTS + BORDER
    assert values(spark, texts, T.is_coherent(F.col("text"))) == [coherent(t) for t in texts]
    assert values(spark, BORDER, T.is_coherent(F.col("text"))) == [True, False, False, False]
    loose = [len(t) > 50 and not (len(t.split()) >= 10 and len(set(t.split())) / len(t.split()) < 0.3) for t in texts]
    assert values(spark, texts, T.is_coherent_loose(F.col("text"))) == loose
    tokens = values(spark, texts, T.is_coherent(F.col("text"), tokens=F.col("tok")), tok=T.words(F.col("text")))
    assert tokens == [coherent(t) for t in texts]


def test_lexicon_scores(spark):
    texts = ["Please HELP and support me", "a window", "the task: win, then help", "hi", "nothing here at all", ""]
    text = F.col("text")
    assert values(spark, texts, T.keyword_hits(text, ["help", "support", "win"])) == [2, 1, 2, 0, 0, 0]
    assert values(spark, texts, T.keyword_hits(text, [])) == [0] * 6
    assert values(spark, texts, T.lexical_majority(text)) == [True, False, False, False, False, False]
    assert values(spark, texts, T.lexical_majority3(text)) == [1.0, 0.0, 0.0, 0.5, 0.5, 0.5]
    ratio = values(spark, texts, T.lexical_ratio(text))
    assert ratio[0] == 1.0 and ratio[1] == 0.0 and ratio[2] == pytest.approx(1 / 3)
    assert ratio[3:] == [0.0, 0.5, 0.0]  # too short, no hits, empty
    assert values(spark, [None], T.lexical_ratio(text)) == [0.0]


def test_markers_need_two_and_a_known_scenario(spark):
    df = spark.createDataFrame(
        [
            ("food_delivery", "User D may lose the ACCOUNT"),
            ("food_delivery", "user d only"),
            ("the_protector", "they bully; I stand up"),
            ("unknown", "user d account delete"),
        ],
        "scenario string, text string",
    )
    got = df.select(T.contains_markers(F.col("text"), F.col("scenario")).alias("x")).collect()
    assert [r["x"] for r in got] == [True, False, True, False]


def test_flags(spark):
    r = values(spark, ["User_D and JIMMI find the exit", "calm"], T.flags(F.col("text")))
    assert r[0]["mentions_user_d"] and r[0]["mentions_jimmi"] and r[0]["task_focus"] and not r[0]["empathy_language"]
    assert not any(r[1].asDict().values())


FORMAT_CASES = [
    ('{"a": 1, {"b": 2}}', "json_schema"),
    ('{"a": 1}', "other"),  # only one brace
    ("a | b", "table/grid"),
    ("```code```", "table/grid"),
    ("title\n ----", "table/grid"),
    ("title --", "other"),
    ("a rule about each step", "rule_list"),
    ("take a step to the cell", "action_sequence"),
    ("the Player A wins", "game_documentation"),
    ("x " * 51, "narrative"),
    ("x " * 50, "other"),
    ("rule of the game", "game_documentation"),
    ("", "other"),
]


def test_format_priority(spark):
    assert values(spark, [t for t, _ in FORMAT_CASES], T.detect_format(F.col("text"))) == [f for _, f in FORMAT_CASES]


def test_prompt_templates_and_prefix_stripping(spark):
    df = spark.createDataFrame([("do it", None, "do it\n\n\n\nWhat do you do?\t I go. \n")], "objective string, pressure string, full string")
    from dosewise.lexicons import TASK_PROMPT

    prompt = T.fill_template(TASK_PROMPT, {"objective": F.col("objective"), "pressure": F.col("pressure")})
    r = df.select(prompt.alias("p"), T.strip_prompt(F.col("full"), prompt).alias("c"), T.strip_prompt(prompt, prompt).alias("e")).first()
    assert r["p"] == "do it\n\n\n\nWhat do you do?" and r["c"] == "I go." and r["e"] == ""


def test_preview_and_fallback(spark):
    assert values(spark, ["abc"], T.preview(F.col("text"), 2)) == ["ab..."]
    df = spark.createDataFrame([(" ", None, " x "), ("a", "b", "c"), (None, "", " ")], "a string, b string, c string")
    got = [r[0] for r in df.select(T.first_non_empty(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == ["x", "a", None]


def test_condition_names(spark):
    df = spark.createDataFrame([(a,) for a in (0.0, -10.0, 1.0, 3.0, 5.0, 7.0, 10.0, 20.0)], "alpha double")
    names = [r[0] for r in df.select(rules.condition_name(F.col("alpha"))).collect()]
    assert names == [
        "baseline", "anti_empathy_10.0", "soft_1.0", "soft_3.0", "median_5.0", "extreme_7.0", "hard_10.0", "extreme_20.0",
    ]
    unsigned = df.select(rules.condition_name(F.col("alpha"), negative_branch=False)).collect()
    assert unsigned[1][0] == "soft_-10.0"
    whole = spark.createDataFrame([(0,)], "alpha int").select(rules.condition_name(F.col("alpha"))).first()[0]
    assert whole == "baseline"


def test_verdicts_targets_and_number_formats(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.31,), (None,)], "x double")
    x = F.col("x")
    assert [r[0] for r in df.select(rules.drop_verdict(x)).collect()] == ["STRONG", "MEDIUM", "WEAK", None]
    spread = spark.createDataFrame([(0.8,), (0.5,), (0.4,)], "x double")
    assert [r[0] for r in spread.select(rules.variance_verdict(x)).collect()] == ["high", "moderate", "low"]
    r = spark.createDataFrame([(-0.4,)], "x double").select(
        rules.correlation_target(x), rules.correlation_target(x, absolute=False), rules.three_decimals(x), rules.percent(x)
    ).first()
    assert tuple(r) == (True, False, "-0.400", "-40.0%")
    assert not math.isnan(0.0)
