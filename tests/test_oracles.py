"""Registered queries against their SQL counterparts at the smallest scale. ``ORACLE=all`` runs every one."""
import os

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = ["quality_kills", "fingerprint_dedupe", "timeline_dedupe", "burst_packs", "top_montages", "merged_clips", "audio_peaks_kill", "window_audio_stats", "line_scores_by_profile", "window_structure", "anchor_peaks",
          "monthly_report", "upsert_projects", "cleanup_candidates", "caption_merge", "keyword_highlights", "speaker_turns", "output_from_source", "best_category", "disjunctive_match", "greedy_nonoverlap", "shooter_selection",
          "event_annotation", "hook_phrases", "panel_chains", "vtt_cues", "stream_sessions", "event_clusters"]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("ORACLE") == "all" else SAMPLE


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    _, _, message = compare(spark, con, SF, entry.queries()[name], entry.oracle_sql()[name])
    assert not message


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
