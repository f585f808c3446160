"""Plans stay as designed: where data moves and how often it is read."""

import pytest
from pyspark.sql import functions as F

from huescope.operators import pairings as pair
from huescope.operators.declarations import union_declarations
from huescope.plans.audit import analyse_pages

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{FOLDER}/pages.parquet")


def test_page_analysis_has_no_shuffle_and_parses_once(pages):
    text = plan(analyse_pages(pages, "page_id").where("total_pairings > 0 AND status = 'analysed'"))
    assert "Exchange" not in text
    assert text.count("FileScan") == 1 and text.count("(?is)(?=<)") == 1
    assert "ReadSchema: struct<page_id:bigint,html:string>" in text


def test_declarations_tokenise_once(pages):
    text = plan(union_declarations(pages, "page_id"))
    assert text.count("FileScan") == 1 and text.count("(?is)(?=<)") == 1


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{FOLDER}/lineitem.parquet").select(
        F.col("l_suppkey").alias("id"),
        F.struct("l_orderkey").alias("seq"),
        F.col("l_linenumber").alias("fg"),
        F.lit(1).alias("bg"),
        F.col("l_tax").alias("ratio"),
        (F.col("l_tax") > 0).alias("pass_normal"),
        (F.col("l_tax") > 0).alias("pass_large"),
    )


def test_duplicates_are_cut_before_the_shuffle(rows):
    text = plan(pair.dedup_pairings(rows, "id"))
    assert text.index(", Final") < text.index("Exchange") < text.index(", Partial")


def test_worst_list_is_cut_before_the_shuffle(rows):
    text = plan(pair.worst_pairings_topk(rows, "id"))
    assert text.index("5, Final") < text.index("Exchange") < text.index("5, Partial")


def test_page_statistics_are_partial(rows):
    text = plan(pair.page_contrast_summary(rows, "id"))
    assert text.count("Exchange") == 1 and "partial_count" in text and "partial_percentile" in text


@pytest.mark.parametrize(
    ("name", "exchanges"),
    [
        ("build_pairings", 1),
        ("dedup_pairings", 1),
        ("filter_failing_pairings", 1),
        ("worst_pairings_topk", 1),
        ("page_contrast_summary", 1),
        ("page_summary_empty", 1),
        ("page_error_status", 1),
    ],
)
def test_row_path_reads_and_tokenises_once(spark, name, exchanges):
    from harness.queries import QUERIES

    text = plan(QUERIES[name](spark, FOLDER))
    assert text.count("FileScan") == 1 and text.count("(?is)(?=<)") == 1
    assert text.count("Exchange") == exchanges and "Exchange hashpartitioning(page_id" in text


def test_report_is_sorted_once(spark, tmp_path, monkeypatch):
    from huescope.operators import report
    from huescope.sources import results

    sites = spark.range(500).select(F.concat(F.lit("d"), F.col("id")).alias("domain"), F.col("id").alias("total_pairings"))
    plans = []
    monkeypatch.setattr(report, "materialised", lambda df, keep=report.materialised: plans.append(plan(df)) or keep(df))
    ranked = report.report_rank(sites)
    plans.append(plan(ranked.sortWithinPartitions("rank")))
    assert sum(p.count("rangepartitioning") for p in plans) == 1
    results.write_report_csv(ranked, str(tmp_path / "r"), single_file=True)
    lines = [f.read_text().split() for f in (tmp_path / "r").glob("part-*.csv")]
    assert [int(x.split(",")[0]) for x in lines[0][1:]] == list(range(1, 501))


def test_row_path_equals_the_page_analysis(spark, pages):
    """Every page, error pages included, has the same statistics either way."""
    from harness.queries import QUERIES

    found = {r["page_id"]: r.asDict() for r in QUERIES["page_summary_empty"](spark, FOLDER).collect()}
    status = {r["page_id"]: (r["status"], r["error"]) for r in QUERIES["page_error_status"](spark, FOLDER).collect()}
    from harness.queries import _styled

    audit = {r["page_id"]: r.asDict() for r in analyse_pages(_styled(spark, FOLDER), "page_id").collect()}
    assert set(audit) == set(found) == set(status) and len(set(status.values())) > 2
    for page, row in audit.items():
        assert (row["status"], row["error"]) == status[page]
        for name in ("total_pairings", "pass_normal", "fail_large", "pass_rate_normal", "worst_ratio", "median_ratio", "mean_ratio"):
            want = row[name] if row["status"] == "analysed" else 0 if name in ("total_pairings", "pass_normal", "fail_large") else None
            assert found[page][name] == want, (page, name)
