"""Queries over texts: lexicon scores, formats, prompts, keyword replacement, pairs and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dosewise import lexicons as L
from dosewise.functions import rules, text as T
from dosewise.operators import ablation as B, splits as S
from dosewise.plans import analyses as A
from workload import views as v
from workload.registry import SPACE, query, r, rounded, sql_any, sql_hits, sql_strip, sql_words, with_views

# Words that occur in the test texts, in place of the default lexicons.
POSITIVE = ["the", "and", "that", "with", "this"]
TASK = ["of", "to", "is", "for", "was"]
MARKERS = {"s0": ["the", "un ", "der"], "s1": ["and", "la ", "die", "que"], "s2": ["of the", "le ", "in", "con"]}
FLAGS = {"articles": ["the ", "der ", "les "], "joins": ["and ", "und "], "digits": ["1", "2", "3"]}
FORMATS = {
    "rules": ["the", "der", "les"],
    "steps": ["ing", "ion", "ung"],
    "grid": ["and", "que", "und"],
    "game": ["is", "la", "ein"],
}
SYNONYMS = {"the": ["and", "that"], "that": ["this", "which"], "and": ["with", "as well as"]}

WORDS = sql_words()
SHARE = f"len(list_distinct({WORDS})) / len({WORDS})"


def documents(spark, sf_dir) -> DataFrame:
    return v.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")


# --- word statistics and lexicon scores ---


@query(
    f"""SELECT doc_id, length(text)::INT AS length, len({WORDS})::INT AS word_count,
               {r(f"CASE WHEN len({WORDS}) > 0 THEN {SHARE} END")} AS distinct_share
    FROM documents"""
)
def text_stats(spark, sf_dir):
    text, tokens = F.col("text"), F.col("tokens")
    return rounded(
        documents(spark, sf_dir)
        .withColumn("tokens", T.words(text))
        .select(
            "doc_id",
            T.length(text).alias("length"),
            T.word_count(text, tokens).alias("word_count"),
            T.distinct_word_share(text, tokens).alias("distinct_share"),
        )
    )


@query(
    f"""SELECT doc_id, length(text) >= 50 AND len({WORDS}) >= 10 AND {SHARE} >= 0.3 AS coherent FROM documents"""
)
def coherent(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.is_coherent(F.col("text")).alias("coherent"))


@query(
    f"""SELECT doc_id, len({WORDS}) >= 10 AND {SHARE} < 0.3 AS repetitive,
               length(text) > 50 AND NOT (len({WORDS}) >= 10 AND {SHARE} < 0.3) AS coherent
    FROM documents"""
)
def coherent_alt(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", T.is_repetitive(F.col("text")).alias("repetitive"), T.is_coherent_loose(F.col("text")).alias("coherent")
    )


@query(
    with_views("gen")
    + " SELECT sample, scenario, CASE scenario "
    + " ".join(f"WHEN '{s}' THEN {sql_hits(t)} >= 2" for s, t in MARKERS.items())
    + " ELSE false END AS has_markers FROM gen"
)
def markers(spark, sf_dir):
    return v.generations(spark, sf_dir).select(
        "sample", "scenario", T.contains_markers(F.col("text"), F.col("scenario"), MARKERS).alias("has_markers")
    )


@query(f"SELECT doc_id, {sql_hits(POSITIVE)} > {sql_hits(TASK)} AS majority FROM documents")
def lex_majority(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.lexical_majority(F.col("text"), POSITIVE, TASK).alias("majority"))


@query(
    f"""SELECT doc_id, CASE WHEN {sql_hits(POSITIVE)} > {sql_hits(TASK)} THEN 1.0::DOUBLE
               WHEN {sql_hits(POSITIVE)} < {sql_hits(TASK)} THEN 0.0 ELSE 0.5 END AS majority
    FROM documents"""
)
def lex_majority3(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.lexical_majority3(F.col("text"), POSITIVE, TASK).alias("majority"))


RATIO_SQL = f"""CASE WHEN length(text) < 10 THEN 0.0 WHEN {sql_hits(POSITIVE)} + {sql_hits(TASK)} = 0 THEN 0.5
    ELSE {sql_hits(POSITIVE)} / ({sql_hits(POSITIVE)} + {sql_hits(TASK)})::DOUBLE END"""


@query(f"SELECT doc_id, {r(RATIO_SQL)} AS ratio FROM documents")
def lex_ratio(spark, sf_dir):
    return rounded(documents(spark, sf_dir).select("doc_id", T.lexical_ratio(F.col("text"), POSITIVE, TASK).alias("ratio")))


@query(f"SELECT doc_id, {sql_hits(POSITIVE)} AS positive_hits, {sql_hits(TASK)} AS task_hits FROM documents")
def keyword_hits(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id",
        T.keyword_hits(F.col("text"), POSITIVE).alias("positive_hits"),
        T.keyword_hits(F.col("text"), TASK).alias("task_hits"),
    )


def _all_lexicons_sql() -> str:
    from dosewise import lexicons as L

    return f"""
        SELECT doc_id, {sql_hits(L.MAJORITY_POSITIVE)} > {sql_hits(L.MAJORITY_TASK)} AS majority,
               CASE WHEN {sql_hits(L.MAJORITY3_POSITIVE)} > {sql_hits(L.MAJORITY3_TASK)} THEN 1.0::DOUBLE
                    WHEN {sql_hits(L.MAJORITY3_POSITIVE)} < {sql_hits(L.MAJORITY3_TASK)} THEN 0.0 ELSE 0.5 END
               AS majority3,
               {sql_hits(L.HITS_POSITIVE)} AS positive_hits, {sql_hits(L.HITS_TASK)} AS task_hits
        FROM documents"""


@query(_all_lexicons_sql())
def default_lexicons(spark, sf_dir):
    from dosewise import lexicons as L

    return documents(spark, sf_dir).select(
        "doc_id",
        T.lexical_majority(F.col("text")).alias("majority"),
        T.lexical_majority3(F.col("text")).alias("majority3"),
        T.keyword_hits(F.col("text"), L.HITS_POSITIVE).alias("positive_hits"),
        T.keyword_hits(F.col("text"), L.HITS_TASK).alias("task_hits"),
    )


@query("SELECT doc_id, " + ", ".join(f"{sql_any(t)} AS {n}" for n, t in FLAGS.items()) + " FROM documents")
def flags(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.flags(F.col("text"), FLAGS).alias("f")).select("doc_id", "f.*")


def format_sql(terms: dict[str, list[str]]) -> str:
    any_of = {k: sql_any(t) for k, t in terms.items()}
    return rf"""CASE
        WHEN regexp_matches(text, '\{{[^}}]*:') AND length(text) - length(replace(text, '{{', '')) > 1
            THEN 'json_schema'
        WHEN contains(text, '|') OR contains(text, '```') OR regexp_matches(text, '\n{SPACE}*[-=]{{3,}}')
            THEN 'table/grid'
        WHEN {any_of['rules']} AND {any_of['steps']} THEN 'rule_list'
        WHEN {any_of['steps']} AND {any_of['grid']} THEN 'action_sequence'
        WHEN {any_of['game']} THEN 'game_documentation'
        WHEN len({WORDS}) > 50 THEN 'narrative' ELSE 'other' END"""


def _default_formats() -> dict[str, list[str]]:
    from dosewise.lexicons import FORMAT_TERMS

    return FORMAT_TERMS


@query(
    f"SELECT doc_id, {format_sql(_default_formats())} AS format, {format_sql(FORMATS)} AS format_by_test_terms "
    "FROM documents"
)
def format_class(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id",
        T.detect_format(F.col("text")).alias("format"),
        T.detect_format(F.col("text"), FORMATS).alias("format_by_test_terms"),
    )


@query(
    f"SELECT page_id, {format_sql(_default_formats()).replace('text', 'html')} AS format FROM pages"
)
def page_format(spark, sf_dir):
    return v.table(spark, sf_dir, "pages").select("page_id", T.detect_format(F.col("html")).alias("format"))


# --- prompts and normalisation ---

TEMPLATE = "SCENARIO: {title}\n{description}\n\nOBJECTIVE: {objective}\n\nPRESSURE: {pressure}"


@query(
    r"""
    SELECT 's' || doc_id AS id,
           md5('SCENARIO: Title ' || source || chr(10) || text || chr(10) || chr(10) || 'OBJECTIVE: Objective of '
               || source || chr(10) || chr(10) || 'PRESSURE: Written in ' || lang) AS prompt_md5,
           'Objective of ' || source || chr(10) || chr(10) || 'Written in ' || lang || chr(10) || chr(10)
               || 'What do you do?' AS task_prompt
    FROM documents"""
)
def prompt_template(spark, sf_dir):
    from dosewise.lexicons import TASK_PROMPT

    fields = {c: F.col(c) for c in ("title", "description", "objective", "pressure")}
    return v.scenarios(spark, sf_dir).select(
        "id",
        F.md5(T.fill_template(TEMPLATE, fields)).alias("prompt_md5"),
        T.fill_template(TASK_PROMPT, fields).alias("task_prompt"),
    )


@query(
    f"""
    SELECT doc_id, md5({sql_strip("substr(source || chr(10) || chr(9) || text || ' ' || chr(10), length(source) + 1)")})
           AS completion_md5
    FROM documents"""
)
def strip_prefix(spark, sf_dir):
    full = F.concat(F.col("source"), F.lit("\n\t"), F.col("text"), F.lit(" \n"))
    return documents(spark, sf_dir).select(
        "doc_id", F.md5(T.strip_prompt(full, F.col("source"))).alias("completion_md5")
    )


@query(
    f"""SELECT doc_id, md5(lower({sql_strip('text')})) AS normal_md5, left(text, 100) || '...' AS preview
    FROM documents"""
)
def normalised_text(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", F.md5(F.lower(T.strip(F.col("text")))).alias("normal_md5"), T.preview(F.col("text"), 100).alias("preview")
    )


# --- pairs and splits ---


@query(
    with_views("pairs")
    + """ SELECT pair_id, 1 AS label, md5(positive_text) AS text_md5 FROM pairs
          UNION ALL SELECT pair_id, 0, md5(negative_text) FROM pairs"""
)
def pairs_long(spark, sf_dir):
    return S.to_long(v.pairs(spark, sf_dir), ["pair_id"]).select("pair_id", "label", F.md5("text").alias("text_md5"))


BLANKED = """, blanked AS (
    SELECT pair_id, CASE run_id % 3 WHEN 0 THEN ' ' || chr(10) ELSE positive_text END AS positive_text, negative_text
    FROM pairs)"""


@query(
    with_views("pairs")
    + BLANKED
    + f" SELECT pair_id FROM blanked WHERE {sql_strip('positive_text')} <> '' AND {sql_strip('negative_text')} <> ''"
)
def drop_blank_pairs(spark, sf_dir):
    blanked = v.pairs(spark, sf_dir).withColumn(
        "positive_text", F.when(F.col("run_id") % 3 == 0, F.lit(" \n")).otherwise(F.col("positive_text"))
    )
    return S.drop_blank_pairs(blanked).select("pair_id")


SPLIT = """, numbered AS (
    SELECT *, CASE WHEN row_number() OVER (ORDER BY md5('42:' || pair_id)) <= floor(0.7 * count(*) OVER ())
                   THEN 'train' ELSE 'test' END AS split FROM pairs)"""


@query(with_views("pairs") + SPLIT + " SELECT pair_id, split FROM numbered")
def split_70_30(spark, sf_dir):
    return S.hash_split(v.pairs(spark, sf_dir), "pair_id").select("pair_id", "split")


@query(
    with_views("pairs")
    + SPLIT
    + """
    SELECT count(*) AS total_pairs, count(*) FILTER (split = 'train') AS train_pairs,
           count(*) FILTER (split = 'test') AS test_pairs,
           array_to_string(list_sort(list_distinct(list(scenario_id))), ',') AS scenarios,
           array_to_string(list_sort(list_distinct(list(source_model))), ',') AS models_used,
           (SELECT string_agg(source_model || ':' || n, ',' ORDER BY source_model) FROM (
              SELECT source_model, max(n) AS n FROM (
                SELECT source_model, count(DISTINCT run_id) AS n FROM numbered GROUP BY source_model, scenario_id)
              GROUP BY source_model)) AS runs_per_model, '2024-01-01' AS generated_at
    FROM numbered"""
)
def split_summary(spark, sf_dir):
    made = F.lit("2024-01-01")
    summary = S.dataset_summary(S.hash_split(v.pairs(spark, sf_dir), "pair_id"), generated_at=made)
    runs = F.transform(F.map_entries("runs_per_model"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    summary = summary.withColumn("runs_per_model", runs)
    return summary.withColumns({c: F.array_join(c, ",") for c in ("scenarios", "models_used", "runs_per_model")})


@query(with_views("pairs") + " SELECT pair_id FROM pairs ORDER BY pair_id LIMIT 35")
def first_n_split(spark, sf_dir):
    return S.first_n_split(v.pairs(spark, sf_dir).select("pair_id"), "pair_id", 35)


# --- keyword replacement ---


def _like(match: str, synonym: str) -> str:
    upper1 = f"substr({match}, 1, 1) <> lower(substr({match}, 1, 1))"
    upper2 = f"substr({match}, 2, 1) <> lower(substr({match}, 2, 1))"
    return (
        f"CASE WHEN {upper1} AND {upper2} THEN upper({synonym}) "
        f"WHEN {upper1} THEN upper(substr({synonym}, 1, 1)) || lower(substr({synonym}, 2)) ELSE lower({synonym}) END"
    )


def ablation_sql(source: str, columns: str, synonyms: dict[str, list[str]], row_id: str) -> str:
    """CTE chain ``step0..stepN`` with the text after each keyword's pass and the counts so far."""
    ctes = [f"step0 AS (SELECT {columns}, text AS t FROM {source})"]
    counted = ""
    for k, (keyword, choices) in enumerate(synonyms.items()):
        pattern = rf"(?i)\b{keyword}\b"
        options = "[" + ", ".join(f"'{c}'" for c in choices) + "]"
        number = f"('0x' || substr(md5({row_id} || ':{keyword}:' || (i - 1) || ':42'), 1, 8))::BIGINT"
        synonym = f"({options})[({number} % {len(choices)} + 1)::INT]"
        ctes.append(
            f"""cut{k} AS (
            SELECT *, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS p FROM step{k})"""
        )
        ctes.append(
            f"""step{k + 1} AS (
            SELECT {columns}{counted}, len(m) AS n{k},
                   array_to_string(list_transform(p, lambda x, i:
                       x || CASE WHEN i <= len(m) THEN {_like('m[i]', synonym)} ELSE '' END), '') AS t
            FROM cut{k})"""
        )
        counted += f", n{k}"
    return ", ".join(ctes)


N = len(SYNONYMS)
TOTAL = " + ".join(f"n{k}" for k in range(N))


@query(
    "WITH "
    + ablation_sql("documents", "doc_id", {"the": SYNONYMS["the"]}, "doc_id")
    + " SELECT doc_id, n0::INT AS replaced, md5(t) AS ablated_md5 FROM step1"
)
def replace_word(spark, sf_dir):
    done = B.replace_word(documents(spark, sf_dir), "text", "doc_id", "the", SYNONYMS["the"])
    return done.select("doc_id", "replaced", F.md5("ablated").alias("ablated_md5"))


@query(
    "WITH "
    + ablation_sql("documents", "doc_id", SYNONYMS, "doc_id")
    + f" SELECT doc_id, md5(t) AS ablated_md5 FROM step{N}"
)
def ablate_text(spark, sf_dir):
    done = B.ablate_text(documents(spark, sf_dir), "text", "doc_id", SYNONYMS)
    return done.select("doc_id", F.md5("ablated").alias("ablated_md5"))


@query(
    "WITH "
    + ablation_sql("documents", "doc_id", SYNONYMS, "doc_id")
    + f""" SELECT doc_id, ({TOTAL})::INT AS total_replacements,
                  ({' + '.join(f'(n{k} > 0)::INT' for k in range(N))})::INT AS unique_keywords FROM step{N}"""
)
def ablation_stats(spark, sf_dir):
    done = B.ablation_stats(B.ablate_text(documents(spark, sf_dir), "text", "doc_id", SYNONYMS))
    return done.select("doc_id", "total_replacements", "unique_keywords")


@query(
    "WITH "
    + ablation_sql("documents", "doc_id", SYNONYMS, "doc_id")
    + ", long AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS keyword, n{i} AS n FROM step{N}" for i, k in enumerate(SYNONYMS))
    + ") SELECT keyword, sum(n)::BIGINT AS replacements, count(*) AS texts FROM long WHERE n > 0 GROUP BY keyword"
)
def keyword_totals(spark, sf_dir):
    return B.keyword_totals(B.ablate_text(documents(spark, sf_dir), "text", "doc_id", SYNONYMS))


KEYWORDS = list(L.SYNONYMS)


@query(
    "WITH led AS (SELECT doc_id, (["
    + ", ".join(f"'{k}'" for k in KEYWORDS)
    + f"])[(doc_id % {len(KEYWORDS)} + 1)::INT] || ' ' || text AS text FROM documents), "
    + ablation_sql("led", "doc_id", L.SYNONYMS, "doc_id")
    + f""" SELECT doc_id, md5(t) AS ablated_md5, ({' + '.join(f'n{k}' for k in range(len(KEYWORDS)))})::INT AS total_replacements
    FROM step{len(KEYWORDS)}"""
)
def default_ablation(spark, sf_dir):
    """The whole default table on documents that each begin with one of its keywords."""
    lead = F.get(F.array(*map(F.lit, KEYWORDS)), (F.col("doc_id") % len(KEYWORDS)).cast("int"))
    led = documents(spark, sf_dir).select("doc_id", F.concat(lead, F.lit(" "), "text").alias("text"))
    done = B.ablation_stats(B.ablate_text(led, "text", "doc_id"))
    return done.select("doc_id", F.md5("ablated").alias("ablated_md5"), "total_replacements")


PAIRS_ABLATED = (
    with_views("pairs")
    + ", src AS (SELECT pair_id, positive_text AS text, negative_text FROM pairs), "
    + ablation_sql("src", "pair_id, negative_text", SYNONYMS, "pair_id")
)


def ablated_pairs_table(spark, sf_dir) -> DataFrame:
    return B.ablate_pairs(v.pairs(spark, sf_dir), SYNONYMS)


@query(
    PAIRS_ABLATED
    + f""" SELECT pair_id, md5(t) AS positive_md5, md5(negative_text) AS negative_md5,
                  ({TOTAL})::INT AS total_replacements FROM step{N}"""
)
def ablated_pairs(spark, sf_dir):
    return ablated_pairs_table(spark, sf_dir).select(
        "pair_id",
        F.md5("positive_text").alias("positive_md5"),
        F.md5("negative_text").alias("negative_md5"),
        "ablation_stats.total_replacements",
    )


@query(
    PAIRS_ABLATED
    + f""" SELECT count(*) AS total_pairs, sum({TOTAL})::BIGINT AS total_replacements,
                  {r(f'avg({TOTAL})')} AS avg_replacements_per_pair,
                  count(*) FILTER ({TOTAL} > 0) AS pairs_with_replacements FROM step{N}"""
)
def ablation_totals(spark, sf_dir):
    return rounded(B.ablation_totals(ablated_pairs_table(spark, sf_dir)))


def _auroc_sql(source: str, name: str) -> str:
    return f"""{name}_r AS (
        SELECT *, rank() OVER (PARTITION BY lang ORDER BY score)
                  + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS rnk FROM {source}),
    {name} AS (
        SELECT lang, CASE WHEN count(*) FILTER (label = 1) * count(*) FILTER (label = 0) = 0 THEN 0.5 ELSE
               (sum(rnk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0)
               / (count(*) FILTER (label = 1)::DOUBLE * count(*) FILTER (label = 0)) END AS auroc,
               avg(((score > 0)::INT = label)::INT) AS accuracy,
               avg(score) FILTER (label = 1) - avg(score) FILTER (label = 0) AS separation
        FROM {name}_r GROUP BY lang)"""


LABELLED = (
    "WITH labelled AS (SELECT d.doc_id, d.lang, d.text, l.quality AS label "
    "FROM documents d JOIN labels l ON d.doc_id = l.doc_id), "
    + ablation_sql("(SELECT * FROM labelled WHERE label = 1)", "doc_id, lang, label", SYNONYMS, "doc_id")
    + f""", before AS (SELECT lang, label, {RATIO_SQL} AS score FROM labelled),
    after AS (SELECT lang, label, {RATIO_SQL.replace('text', 't')} AS score FROM step{N}
              UNION ALL SELECT lang, label, score FROM before WHERE label = 0), """
    + _auroc_sql("before", "a0")
    + ", "
    + _auroc_sql("after", "a1")
)


def scorer(text):
    return T.lexical_ratio(text, POSITIVE, TASK)


@query(
    LABELLED
    + f"""
    SELECT lang, {r('a0.auroc')} AS auroc_original, {r('a1.auroc')} AS auroc_ablated,
           {r('a0.auroc - a1.auroc')} AS auroc_drop,
           {r('(a0.auroc - a1.auroc) / nullif(a0.auroc, 0) * 100')} AS auroc_drop_percent,
           {r('a0.accuracy - a1.accuracy')} AS accuracy_drop,
           CASE WHEN a0.auroc - a1.auroc < 0.15 THEN 'STRONG' WHEN a0.auroc - a1.auroc > 0.30 THEN 'WEAK'
                ELSE 'MEDIUM' END AS verdict
    FROM a0 JOIN a1 USING (lang)"""
)
def ablation_report(spark, sf_dir):
    return rounded(A.ablation_report(v.labelled_texts(spark, sf_dir), scorer, ["lang"], SYNONYMS, "doc_id"))


@query(
    LABELLED
    + ", long AS ("
    + " UNION ALL ".join(
        f"SELECT lang, '{metric}' AS metric, {r(metric)} AS value, '{variant}' AS variant FROM {table}"
        for table, variant in (("a0", "original"), ("a1", "ablated"))
        for metric in ("auroc", "separation")
    )
    + ") SELECT * FROM long"
)
def ablation_metrics_long(spark, sf_dir):
    both = A.text_ablation_metrics(v.labelled_texts(spark, sf_dir), scorer, ["lang"], SYNONYMS, "doc_id")
    original, ablated = (both.filter(F.col("variant") == name) for name in ("original", "ablated"))
    return rounded(B.metrics_long(original, ablated, ["lang"], ["auroc", "separation"]))


@query(
    with_views("gen")
    + """ SELECT sample, alpha,
        CASE WHEN alpha = 0 THEN 'baseline' WHEN alpha < 0 THEN 'anti_empathy_' || abs(alpha)
             WHEN alpha <= 3 THEN 'soft_' || alpha WHEN alpha = 5 THEN 'median_' || alpha
             WHEN alpha = 10 THEN 'hard_' || alpha ELSE 'extreme_' || alpha END AS condition_name,
        CASE WHEN alpha = 0 THEN 'baseline' WHEN alpha <= 3 THEN 'soft_' || alpha WHEN alpha = 5 THEN 'median_' || alpha
             WHEN alpha = 10 THEN 'hard_' || alpha ELSE 'extreme_' || alpha END AS condition_name_unsigned
    FROM gen"""
)
def condition_name(spark, sf_dir):
    alpha = F.col("alpha")
    return v.generations(spark, sf_dir).select(
        "sample",
        "alpha",
        rules.condition_name(alpha).alias("condition_name"),
        rules.condition_name(alpha, negative_branch=False).alias("condition_name_unsigned"),
    )
