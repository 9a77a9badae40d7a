"""Rounds of re-detection: answers of round k arrive as data, only unfinished slides go on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidemesh.runtime import cut


def run_rounds(slides: DataFrame, detect: Callable[[DataFrame, int], DataFrame], review: Callable[[DataFrame, int], DataFrame], max_rounds: int = 3) -> DataFrame:
    """All components with iter_idx. A slide continues while its review asks for it and, after round 0, while the round gave it a component.

    detect(slides, k) -> components with slide_id; review(components, k) -> slide_id, needs_rerun. Every round is written."""
    live, out = slides.select("slide_id"), None
    for k in range(max_rounds):
        comps = cut(detect(live, k).withColumn("iter_idx", F.lit(k)))
        out = comps if out is None else out.unionByName(comps)
        again = review(comps, k).where("needs_rerun").select("slide_id").distinct()
        if k > 0:
            again = again.join(comps.select("slide_id").distinct(), "slide_id", "left_semi")
        live = cut(live.join(again, "slide_id", "left_semi"))
        if live.isEmpty():
            break
    return out
