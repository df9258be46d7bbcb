"""Registry of queries and their checking SQL, and the SQL forms of the shared views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers the function under its name, with the SQL DuckDB runs on the same tables."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Double columns rounded, and a negative zero made positive, as ``r`` does in SQL."""
    return df.select(
        *[
            (F.round(f.name, digits) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def r(expression: str, digits: int = 6) -> str:
    return f"(round({expression}, {digits}) + 0.0)"


def with_views(*names: str) -> str:
    """WITH clause of the named views, in order."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)


SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_words(text: str = "text") -> str:
    return f"list_filter(regexp_split_to_array({text}, '{SPACE}+'), lambda w: w <> '')"


def sql_strip(text: str) -> str:
    return rf"regexp_replace({text}, '\A{SPACE}+|{SPACE}+\z', '', 'g')"


def sql_hits(terms: list[str], text: str = "text") -> str:
    return "(" + " + ".join(f"contains(lower({text}), '{t}')::INT" for t in terms) + ")"


def sql_any(terms: list[str], text: str = "text") -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{t}')" for t in terms) + ")"


VIEWS = {
    "act": """
        SELECT 'm' || (c // 5) AS model, c % 5 AS layer, vec_id AS text_id, (label = c)::INT AS label,
               CASE WHEN vec_id % 10 < 7 THEN 'train' ELSE 'test' END AS split, embedding::DOUBLE[] AS vec
        FROM embeddings, (SELECT unnest(range(0, 10))::INT AS c)""",
    "long_means": """
        SELECT model, layer, label, i, avg(x) AS x, count(*) AS n
        FROM (SELECT model, layer, label, generate_subscripts(vec, 1) AS i, unnest(vec) AS x
              FROM act WHERE split = 'train')
        GROUP BY ALL""",
    "diffs": """
        SELECT model, layer, i, max(x) FILTER (label = 1) - max(x) FILTER (label = 0) AS d,
               max(n) FILTER (label = 1) AS n_pos, max(n) FILTER (label = 0) AS n_neg
        FROM long_means GROUP BY ALL""",
    "norms": """
        SELECT model, layer, sqrt(sum(d * d)) AS norm, list(d ORDER BY i) AS diff,
               max(n_pos) AS n_pos, max(n_neg) AS n_neg
        FROM diffs GROUP BY ALL""",
    "dirs": """
        SELECT model, layer, norm, n_pos, n_neg, list_transform(diff, lambda x: x / norm) AS direction
        FROM norms""",
    "scores": """
        SELECT a.model, a.layer, a.text_id, a.label, round(list_dot_product(a.vec, d.direction), 9) AS score
        FROM act a JOIN dirs d ON a.model = d.model AND a.layer = d.layer WHERE a.split = 'test'""",
    "ranked": """
        SELECT *, rank() OVER (PARTITION BY model, layer ORDER BY score)
                  + (count(*) OVER (PARTITION BY model, layer, score) - 1) / 2.0 AS rnk,
               quantile_cont(score, 0.5) OVER (PARTITION BY model, layer) AS med,
               (avg(score) FILTER (label = 1) OVER (PARTITION BY model, layer)
                + avg(score) FILTER (label = 0) OVER (PARTITION BY model, layer)) / 2 AS mid
        FROM scores""",
    "aurocs": """
        SELECT model, layer, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg,
               CASE WHEN count(*) FILTER (label = 1) * count(*) FILTER (label = 0) = 0 THEN 0.5 ELSE
               (sum(rnk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0)
               / (count(*) FILTER (label = 1)::DOUBLE * count(*) FILTER (label = 0)) END AS auroc
        FROM ranked GROUP BY model, layer""",
    "ratings": "SELECT vec_id AS text_id, label % 3 AS true_score FROM embeddings",
    "rated": """
        SELECT s.model, s.layer, s.text_id, s.score, t.true_score
        FROM scores s JOIN ratings t ON s.text_id = t.text_id""",
    "states": """
        SELECT vec_id // 5 AS text_id, vec_id % 5 AS pos, embedding::DOUBLE[] AS vec FROM embeddings""",
    "gen": """
        SELECT lang AS model, (doc_id % 2)::INT AS layer, 's' || (substr(source, 4)::INT % 3) AS scenario,
               ([-20.0, -10.0, -5.0, 0.0, 5.0, 10.0, 20.0]::DOUBLE[])[((doc_id // 2) % 7 + 1)::INT] AS alpha,
               doc_id AS sample, text
        FROM documents""",
    "pairs": """
        SELECT u.conv_id || '-' || u.turn AS pair_id, 's' || (u.conv_id % 5) AS scenario_id,
               'm' || (u.turn % 2) AS source_model, u.turn::INT AS run_id,
               a.text AS positive_text, u.text AS negative_text
        FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
        WHERE u.role = 'user' AND a.role = 'assistant'""",
}
SCORE_VIEWS = ("act", "long_means", "diffs", "norms", "dirs", "scores")
AUROC_VIEWS = (*SCORE_VIEWS, "ranked", "aurocs")
