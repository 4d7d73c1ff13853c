"""Physical plans: what is pushed down, shuffled, broadcast, or sent to Python."""

import contextlib
import io

import pytest

from contract.fixtures import view
from jobloom.operators import coverage, dedupe
from jobloom.operators import reconcile as rc
from jobloom.plans.discovery import candidates
from jobloom.sources import aggregator

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Postings and state as parquet tables, as a run finds them."""
    root = str(tmp_path_factory.mktemp("stored"))
    for name in ("postings_fx", "prior_jobs_fx"):
        view(spark, SF, name).write.parquet(f"{root}/{name}")
    return lambda name: spark.read.parquet(f"{root}/{name}")


def test_dedupe_stays_in_the_jvm_and_shuffles_keys_once(spark, stored):
    p = plan(dedupe.cross_source_dedupe(stored("postings_fx").drop("description")))
    assert "UDF" not in p and "CartesianProduct" not in p and "NestedLoop" not in p
    assert "description" not in p
    assert "Window" not in p


def test_reconcile_shuffles_each_side_once(spark, stored):
    slim = stored("postings_fx").drop("description")
    rec = rc.reconcile(slim, stored("prior_jobs_fx"), "now")
    p = plan(rc.next_state(rec))
    assert p.count("hashpartitioning(job_id") == 2
    assert "UDF" not in p and "description" not in p


def test_active_filter_reaches_the_scan(spark, stored):
    p = plan(rc.active_keys(stored("prior_jobs_fx")))
    assert "EqualTo(status,active)" in p
    assert "ReadSchema: struct<company:string,title:string,location:string,status:string>" in p


def test_row_caps_cut_before_the_shuffle(spark):
    listings = view(spark, SF, "listings_fx")
    p = plan(aggregator.source_filters(listings, "1998-01-01", 72, 100))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_missing_sample_cuts_before_the_shuffle(spark):
    found = candidates(view(spark, SF, "crawl_text_fx"), "texts", "page_id")
    from jobloom.sources.registry import with_board_key

    boards = with_board_key(view(spark, SF, "boards_fx"))
    p = plan(coverage.missing_sample(coverage.funnel_keys(found, boards), 15))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_extraction_is_narrow(spark, stored):
    texts = spark.read.parquet(f"{SF}/pages.parquet").selectExpr("page_id", "html AS body")
    p = plan(candidates(texts, "texts", "page_id"))
    assert "Exchange" not in p and "Python" not in p
    assert "ReadSchema: struct<page_id:bigint,html:string>" in p
