import pytest
from pyspark.sql import functions as F

from huescope import schemas
from huescope.functions.categories import categorise_domain
from huescope.operators import report as rep
from huescope.sources import results as res
from huescope.sources.shared import materialised

CATEGORIES = {
    "adelaide.edu.au": "Education", "unt.edu": "Education", "senate.gov": "Government", "af.mil": "Government",
    "culture.gouv.fr": "Government", "nasa.gov": "Government", "si.edu": "Education",
    "wikipedia.org": "Open Knowledge", "en.wikipedia.org": "Open Knowledge", "notwikipedia.org": "Other",
    "cern.ch": "Research", "GitHub.com": "Technology", "substack.com": "Hosting/Platform", "amazon.com": "E-commerce",
    "cnet.com": "News/Media", "europa.eu": "EU Institutions", "admin.ch": "Other", "gov.sk": "Other",
    "163.com": "Other", "x.admin.ch": "Government", "a.edu.mx": "Education", "www.github.com": "Other",
}


def test_categories(spark):
    df = spark.createDataFrame([(d,) for d in CATEGORIES], "domain string")
    rows = df.select("domain", categorise_domain(F.col("domain")).alias("category")).collect()
    assert {r["domain"]: r["category"] for r in rows} == CATEGORIES


def site(domain, normal, total, status="analysed", worst=1.0):
    rate = round(normal / total * 100, 1) if total else None
    return {
        "domain": domain, "status": status, "total_pairings": total, "pass_normal": normal,
        "fail_normal": None if total is None else total - normal, "pass_large": normal,
        "fail_large": None if total is None else total - normal, "pass_rate_normal": rate,
        "pass_rate_large": rate, "worst_ratio": worst if total else None, "mean_ratio": 5.0 if total else None,
        "median_ratio": 5.0 if total else None,
        "worst_pairings": [{"foreground": "#777", "background": "#fff", "ratio": 4.48}] if total and normal < total else None,
    }


SITES = [
    site("a.edu", 10, 10),
    site("b.edu", 2000, 2001),  # 100.0 once rounded, so compliant
    site("c.com", 0, 3, worst=1.2),
    site("d.com", 1, 4),
    site("e.com", 26, 32),  # 81.25 rounds to 81.2
    site("f.com", 9, 10),
    site("g.com", 1, 2),
    site("h.com", 3, 4),
    site("i.com", 0, 0),
    site("j.com", None, None, status="error"),
]


@pytest.fixture(scope="module")
def results(spark):
    return materialised(spark.createDataFrame(SITES, schemas.RESULTS))


def test_summary(results):
    s = rep.audit_summary(results, "C").first()
    assert (s.total_domains_in_list, s.domains_analysed, s.domains_with_color_data) == (10, 9, 8)
    assert (s.domains_no_color_data, s.domains_failed, s.total_unique_pairings) == (1, 1, 2066)
    assert s.total_failing_normal == 0 + 1 + 3 + 3 + 6 + 1 + 1 + 1
    assert s.pass_rate_distribution == {"0-25%": 1, "25-50%": 1, "50-75%": 1, "75-90%": 2, "90-99%": 1, "100%": 2}
    assert s.mean_pass_rate_normal == round((100 + 100 + 0 + 25 + 81.2 + 90 + 50 + 75) / 8, 1)
    assert (s.median_pass_rate_normal, s.min_pass_rate_normal, s.max_pass_rate_normal) == (81.2, 0.0, 100.0)
    assert (s.pct_fully_compliant_normal, s.pct_above_90_normal) == (25.0, 37.5)
    assert (s.pct_above_75_normal, s.pct_below_50_normal) == (62.5, 25.0)
    assert [w.domain for w in s.worst_offenders][:3] == ["c.com", "d.com", "g.com"]
    assert s.worst_offenders[0].example_failure.ratio == 4.48
    assert s.worst_offenders[-1].domain == "b.edu"
    assert [(c.domain, c.total_pairings) for c in s.fully_compliant_sites] == [("b.edu", 2001), ("a.edu", 10)]
    assert s.category_analysis["Education"].asDict() == {
        "count": 2, "avg_pass_rate": 100.0, "median_pass_rate": 100.0, "fully_compliant": 2, "below_50_pct": 0,
    }
    assert list(s.category_analysis) == ["Education", "Other"]
    assert s.min_worst_ratio_across_sites == 1.0


def test_parts_equal_the_summary(results):
    s = rep.audit_summary(results, "C").first().asDict(True)
    for part in (rep.corpus_counts, rep.pairing_totals, rep.rate_stats, rep.threshold_shares, rep.min_worst_ratio):
        for name, value in part(results).first().asDict().items():
            assert s[name] == value, name
    buckets = {r["bucket"]: r["sites"] for r in rep.pass_rate_histogram(results).collect()}
    assert buckets == s["pass_rate_distribution"]


def test_no_colours_gives_the_message(results):
    empty = rep.summary_empty_guard(rep.audit_summary(results.where("domain >= 'i'"), "C")).first()
    assert empty.error == "No domains with color data found" and empty.domains_analysed is None
    full = rep.summary_empty_guard(rep.audit_summary(results, "C")).first()
    assert full.error is None and full.domains_analysed == 9


def test_report_file(spark, results, tmp_path):
    path = str(tmp_path / "report")
    res.write_report_csv(rep.audit_report(results), path, single_file=True)
    lines = next(tmp_path.glob("report/*.csv")).read_text().splitlines()
    assert lines[0] == ",".join(f.split(" ")[0] for f in schemas.REPORT.split(", "))
    assert lines[1] == "1,a.edu,Education,10,10,0,100.0,10,0,100.0,1.0,5.0,5.0,Yes,Yes"
    assert [line.split(",")[1] for line in lines[1:]] == [f"{c}.{'edu' if c < 'c' else 'com'}" for c in "abcdefgh"]
    assert res.scan_report_csv(spark, path).count() == 8


def test_rank_over_many_partitions(spark):
    rows = spark.range(50000).select(F.sha1(F.col("id").cast("string")).alias("domain"))
    ranked = {r["domain"]: r["rank"] for r in rep.report_rank(rows).collect()}
    assert [ranked[d] for d in sorted(ranked)] == list(range(1, 50001))


def test_summary_file(spark, results, tmp_path):
    summary = rep.audit_summary(results, "C")
    res.write_summary_json(summary, str(tmp_path / "s"))
    back = spark.read.schema(summary.schema).json(str(tmp_path / "s")).first()
    assert back.category_analysis == summary.first().category_analysis
