"""SQL for those queries of this package that SQL can express over whole tables.

The others have none: alignments, tokenizers, fitted models, hashes that SQL engines don't share, components of large graphs.
They are tested against brute force on small fixtures.
"""

from tideline.rng import u01_sql

_CLIPS = "cl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) AS rn_ FROM clips WHERE id IS NOT NULL) WHERE rn_ = 1)"


def _plain(c: str) -> str:
    return f"nullif(regexp_replace(lower(trim({c})), '[\\s\\-]+', '_', 'g'), '')"


_AXES = ("temporal_sparsity", "perceptual_subtlety", "modality_locus", "context_dependence")
_MEMBERS = (
    f"mb AS (SELECT id, {_plain('split')} AS sp, 'category' AS dim, CASE WHEN label.safe THEN 'safe' ELSE {_plain('label.categories[1]')} END AS cat FROM cl "
    + " ".join(f"UNION ALL SELECT id, {_plain('split')}, '{a}', {_plain(f'axes.{a}.bin')} FROM cl" for a in _AXES)
    + ")"
)
_QUOTAS = (
    f"WITH {_CLIPS}, {_MEMBERS}, hv AS (SELECT sp, dim, cat, count(*) AS available FROM mb WHERE sp IS NOT NULL AND cat IS NOT NULL GROUP BY ALL), "
    f"rq AS (SELECT * REPLACE (coalesce(target_share, 0) AS target_share, coalesce(min_count, 0) AS min_count, coalesce(sample_size, 0) AS sample_size), {_plain('split')} AS sp, {_plain('dimension')} AS dim, {_plain('category')} AS cat FROM (SELECT DISTINCT * FROM sample_targets)), "
    "q AS (SELECT rq.*, coalesce(hv.available, 0) AS available FROM rq LEFT JOIN hv USING (sp, dim, cat)), "
    "w AS (SELECT *, greatest(min_count, target_share * sample_size) AS need, least(available, greatest(min_count, CAST(round(target_share * sample_size) AS BIGINT))) AS wanted FROM q)"
)
_DRAWN = (
    _QUOTAS + f", dr AS (SELECT w.request_id, w.category, mb.id, wanted, row_number() OVER (PARTITION BY w.request_id, w.category ORDER BY {u01_sql(7, 'w.request_id', 'w.category', 'mb.id')}, mb.id) AS r FROM w JOIN mb USING (sp, dim, cat))"
)

SQL: dict[str, str] = {
    "p3_found": _QUOTAS + " SELECT DISTINCT request_id, category FROM w WHERE available < need - 1e-9",
    "p3_sample": _DRAWN + " SELECT request_id, category, id FROM dr WHERE r <= wanted",
    "p3_report": _QUOTAS + " SELECT request_id, category, target_share, available, wanted, wanted AS taken, round(CAST(wanted / sum(wanted) OVER (PARTITION BY request_id) AS DOUBLE), 6) AS actual_share, available < need - 1e-9 AS short, round(greatest(0, need - least(available, ceil(need - 1e-9))), 6) AS missing FROM w",
}
