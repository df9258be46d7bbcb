"""Keyword replacement against a per-occurrence Python model with the same hash choice."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from dosewise import lexicons as L
from dosewise.operators import ablation as B

TEXTS = [
    "Help me; HELP! he helps, self-help and Helpful helping.",
    "Empathy is care. EMPATHY IS CARE",
    "No keyword in this one",
    "",
    "well-being and Well-Being, cared for: They Cared.",
    "été help éhelp helpé _help help_",
    "Support support understanding empathic\nkind-hearted kind",
]


def model(text, row_id, synonyms, seed=42):
    counts, log = {}, []
    for keyword, options in synonyms.items():
        seen = 0

        def swap(m):
            nonlocal seen
            digest = hashlib.md5(f"{row_id}:{keyword}:{seen}:{seed}".encode()).hexdigest()
            word = options[int(digest[:8], 16) % len(options)]
            found = m.group(0)
            if found[0].isupper():
                word = word.upper() if len(found) > 1 and found[1].isupper() else word.capitalize()
            else:
                word = word.lower()
            log.append((keyword, found, word, m.start()))
            seen += 1
            return word

        text = re.sub(rf"\b{re.escape(keyword)}\b", swap, text, flags=re.IGNORECASE)
        if seen:
            counts[keyword] = seen
    return text, counts, log


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").repartition(3)


def test_default_table_matches_the_model(df):
    rows = B.ablate_text(df, "text", "id", with_log=True).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text, counts, log = model(r["text"], r["id"], L.SYNONYMS)
        assert r["ablated"] == text and r["keyword_counts"] == counts
        assert [tuple(x) for x in r["replacements"]] == log


def test_cascade_counts_both_passes(spark):
    one = spark.createDataFrame([(1, "empathy")], "id int, text string")
    table = {"empathy": ["understanding"], "understanding": ["grasping"]}
    r = B.ablation_stats(B.ablate_text(one, "text", "id", table)).first()
    assert r["ablated"] == "grasping" and r["total_replacements"] == 2 and r["unique_keywords"] == 2
    again = B.ablate_text(one, "text", "id", dict(reversed(table.items()))).first()
    assert again["ablated"] == "understanding"


def test_case_and_quotes_and_two_word_synonyms(spark):
    one = spark.createDataFrame([(1, "Cared cared CARED")], "id int, text string")
    r = B.ablate_text(one, "text", "id", {"cared": ["looked o'er \\1 $0"]}).first()
    assert r["ablated"] == "Looked o'er \\1 $0 looked o'er \\1 $0 LOOKED O'ER \\1 $0"


def test_result_does_not_depend_on_partitioning(df):
    a = {r["id"]: r["ablated"] for r in B.ablate_text(df, "text", "id").collect()}
    b = {r["id"]: r["ablated"] for r in B.ablate_text(df.coalesce(1), "text", "id").collect()}
    assert a == b


def test_one_keyword_many_occurrences_vary(spark):
    one = spark.createDataFrame([(1, "help " * 200), (2, "none")], "id int, text string")
    rows = {r["id"]: r for r in B.replace_word(one, "text", "id", "help", ["aid", "assist"]).collect()}
    assert rows[1]["replaced"] == 200 and {"aid", "assist"} == set(rows[1]["ablated"].split())
    assert rows[2]["replaced"] == 0 and rows[2]["ablated"] == "none"


def test_pairs_totals_and_untouched_negatives(spark):
    pairs = spark.createDataFrame(
        [("p1", "help help", "help"), ("p2", "calm", "care")], "pair_id string, positive_text string, negative_text string"
    )
    done = B.ablate_pairs(pairs, with_log=True)
    rows = {r["pair_id"]: r for r in done.collect()}
    assert rows["p1"]["negative_text"] == "help" and "help" not in rows["p1"]["positive_text"]
    assert rows["p2"]["positive_text"] == "calm" and rows["p2"]["ablation_stats"]["total_replacements"] == 0
    total = sum(len(rows[p]["ablation_stats"]["replacements"]) for p in rows)
    t = B.ablation_totals(done).first()
    assert (t["total_pairs"], t["total_replacements"], t["pairs_with_replacements"]) == (2, total, 1)
    assert t["avg_replacements_per_pair"] == total / 2
    empty = B.ablation_totals(done.filter(F.lit(False))).first()
    assert (empty["total_pairs"], empty["total_replacements"], empty["avg_replacements_per_pair"]) == (0, 0, 0.0)
