"""Pieces of SQL that several oracles share."""

CLIPS = "cl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) AS rn_ FROM clips WHERE id IS NOT NULL) WHERE rn_ = 1)"
FRAMES = "fr AS (SELECT stream_id, tick, any_value(t_s) AS t_s, any_value(score) AS score, any_value(ood) AS ood, any_value(channels) AS channels, any_value(action_raw) AS action_raw, any_value(risk) AS risk, any_value(err) AS err, any_value(nu_s) AS nu_s FROM frames GROUP BY stream_id, tick)"
EMB = "em AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts)


JSON_TEXT = r"""CASE WHEN regexp_extract({c}, '```(?:json)?\s*(\{{.*?\}})\s*```', 1, 's') <> '' THEN regexp_extract({c}, '```(?:json)?\s*(\{{.*?\}})\s*```', 1, 's')
 WHEN regexp_extract({c}, '\{{.*\}}', 0, 's') <> '' THEN regexp_extract({c}, '\{{.*\}}', 0, 's') END"""


def json_text(c: str) -> str:
    return JSON_TEXT.format(c=c)


def citation(c: str) -> str:
    junk = "'[]()<>「」 ' || chr(9) || chr(10) || '\"''`'"
    x = f"trim({c}, {junk})"
    x = f"trim(regexp_replace({x}, '^(?:id=|id:|policy_id=|条款id=|条款=)', '', 'i'), {junk})"
    return f"CASE WHEN lower({x}) NOT IN ('', 'none', 'null', 'n/a', 'na', '无', '不适用') THEN {x} END"


#: Frames with the parsed step: action, category, citation, confidence.
STEPS = (
    FRAMES
    + f", j1 AS (SELECT *, {json_text('action_raw')} AS js FROM fr WHERE action_raw IS NOT NULL), j2 AS (SELECT * EXCLUDE (js), CASE WHEN json_valid(js) THEN js END AS js FROM j1)"
    + f", j3 AS (SELECT *, json_extract_string(js, '$.action') AS a0, json_extract_string(js, '$.category') AS category, {citation("json_extract_string(js, '$.policy_citation')")} AS citation, CAST(json_extract_string(js, '$.confidence') AS DOUBLE) AS confidence, json_extract_string(js, '$.suggested_category') AS suggested FROM j2)"
    + ", st AS (SELECT *, CASE WHEN a0 IN ('hold', 'clear', 'uncovered') OR (a0 = 'flag' AND citation IS NOT NULL) THEN a0 ELSE 'invalid' END AS action FROM j3)"
)


def clopper_pearson(k: str, n: str, delta: float, source: str, out: str) -> str:
    """CTEs that bisect the exact upper bound for each (k, n) of ``source``; ``out`` has k, n, ucb. Needs WITH RECURSIVE."""
    tail = "list_sum(list_transform(range(CAST(k AS BIGINT) + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln((lo + hi) / 2) + (n - j) * ln(1 - (lo + hi) / 2))))"
    return (
        f"{out}_kn AS (SELECT DISTINCT {k} AS k, {n} AS n FROM {source} WHERE {n} > 0), "
        f"{out}_b AS (SELECT k, n, k / n AS lo, 1.0::DOUBLE AS hi, 0 AS it FROM {out}_kn WHERE k < n UNION ALL SELECT k, n, CASE WHEN {tail} > {delta} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {tail} > {delta} THEN hi ELSE (lo + hi) / 2 END, it + 1 FROM {out}_b WHERE it < 60), "
        f"{out} AS (SELECT k, n, hi AS ucb FROM {out}_b WHERE it = 60 UNION ALL SELECT k, n, 1.0 FROM {out}_kn WHERE k >= n)"
    )
