"""Every registered query equals its SQL on the smallest data folder (rows-only queries must run)."""

import os

import pytest

import oracle

import __spark_entry__ as entry

FOLDER = os.environ.get("CUELOOM_TEST_DATA", "/root/testdata/sf0.001")
QUICK = ["speaker_rollup", "speaker_runs", "segment_risks", "qa_summary", "scorecard", "delivery_blockers", "repair_queue", "attempt_grid", "timeline_fit", "run_aggregates",
         "compare_runs", "pair_scores", "registry_match", "assign_labels", "diarization_error", "mask_ranges", "apply_decisions", "infer_works", "parse_subtitles", "stream_sessions"]
NAMES = list(entry.queries()) if os.environ.get("CUELOOM_ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    checks = entry.oracle_sql()
    if name in checks:
        _, problem = oracle.compare(spark, con, FOLDER, entry.queries()[name], checks[name])
        assert problem is None
    else:
        assert entry.queries()[name](spark, FOLDER).count() >= 0
