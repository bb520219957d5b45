"""Voice intervals from recogniser segments and energy intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmine.operators.intervals import merge_intervals
from clipmine.operators.joins import extend_by_touching, iou_semi_join
from clipmine.operators.signals import interval_totals, speech_from_segments


def voice_intervals(segments: DataFrame, energy: DataFrame, mode: str = "asr_primary") -> DataFrame:
    """`asr_primary`: recogniser spans with ends stretched by energy that overlaps them;
    `merged`: both joined; `energy`: energy alone where a recording has any."""
    asr = speech_from_segments(segments)
    energy = energy.select("vod_id", "start", "end")
    if mode == "energy":
        return energy.unionByName(asr.join(energy.select("vod_id").distinct(), "vod_id", "left_anti"))
    kept = iou_semi_join(energy, asr, iou_min=0.2)
    if mode == "merged":
        return merge_intervals(asr.unionByName(kept), 0.2)
    return merge_intervals(extend_by_touching(asr, kept, pad=0.15), 0.35)


def voice_debug(segments: DataFrame, energy: DataFrame, mode: str = "asr_primary") -> DataFrame:
    """Interval counts and seconds per source, per recording."""
    asr = speech_from_segments(segments)
    parts = [
        interval_totals(asr, "asr"),
        interval_totals(energy, "energy"),
        interval_totals(iou_semi_join(energy.select("vod_id", "start", "end"), asr), "energy_kept").drop("energy_kept_total_sec"),
        interval_totals(voice_intervals(segments, energy, mode), "speech"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "vod_id", "full")
    return out.na.fill(0)
