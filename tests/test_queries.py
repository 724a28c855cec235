"""Registered queries against their oracles on the small tables. ``FEEDLAKE_ALL=1`` runs every query."""

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT / "tools"))

import check  # noqa: E402

from feedlake.plans import catalog  # noqa: E402

FOLDER = "/root/testdata/sf0.01"
SAMPLE = [
    "a02_decode_responses", "a05_parse_url_labels", "b01_canonicalize_urls", "b04_canonical_equal_join", "b10_resolve_redirects",
    "b17_rollup_parent_urls", "c05_infer_feed_order", "c18_api_posts", "e01_page_links", "e06_text_dates", "e09_common_affixes",
    "f05_collapse_runs", "g11_page2_links", "g15_assemble_paged", "h05_load_manual_categories", "i05_schedule_preview",
    "j02_next_runs", "k01_next_posts", "k03_final_items", "k11_publish_plan", "l09_telemetry_dashboard",
    "l11_progress_regressions", "l12_triage_bounces", "l17_stream_telemetry", "m07_parse_review_notes", "n03_feed_stats",
    "n04_merge_feed_lists",
]
NAMES = sorted(catalog.QUERIES) if os.environ.get("FEEDLAKE_ALL") else SAMPLE

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not on this machine")


@pytest.fixture(scope="module")
def oracle():
    return check.duck(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, oracle, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    if name in catalog.ORACLES:
        problems, n = check.compare(df, oracle, catalog.ORACLES[name])
        assert not problems
    else:
        n = df.count()
    assert n > 0


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
