"""Bins of the four axes. A null input has no bin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The lower edges of the bins.
SPARSITY = ((0.01, "dense"), (0.001, "sparse"))
SUBTLETY = ((0.05, "salient"), (0.01, "moderate"))
SHORT_CONTEXT_S = 10.0
LOCUS = {"pixel": "visual", "motion": "visual", "speech": "speech", "ocr": "text"}


def temporal_sparsity(ratio: Column) -> Column:
    out = F.when(ratio.isNull(), F.lit(None))
    for edge, name in SPARSITY:
        out = out.when(ratio >= edge, name)
    return out.otherwise("ultra_sparse")


def perceptual_subtlety(area: Column, requires_ocr: Column) -> Column:
    out = F.when(F.coalesce(requires_ocr, F.lit(False)), "subtle").when(area.isNull(), F.lit(None))
    for edge, name in SUBTLETY:
        out = out.when(area >= edge, name)
    return out.otherwise("subtle")


def context_dependence(window_s: Column) -> Column:
    return F.when(window_s.isNull(), F.lit(None)).when(window_s <= 0, "self_contained").when(window_s <= SHORT_CONTEXT_S, "short_context").otherwise("long_context")


def modality_locus(decisive: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LOCUS.items() for x in kv])
    return F.when(decisive.isNull(), F.lit(None)).when(F.size(decisive) > 1, "multi").otherwise(F.coalesce(F.element_at(table, F.get(decisive, F.lit(0))), F.lit("composition")))
