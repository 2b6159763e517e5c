"""The audit report as a whole, and the published score histogram."""

from pyspark.sql import functions as F

from wayfolio.operators.aggregates import score_distribution, summary
from wayfolio.plans.audit import audit_report, report_long

# Published figures: rows per quality score, and their mean.
HISTOGRAM = {5: 104, 6: 3658, 7: 2951, 8: 63, 9: 143, 10: 20, 11: 1, 12: 11}
MEAN = 6.51
FILLED = {
    5: "description denomination city address",
    6: "description denomination city address religion",
    7: "description denomination city address religion coordinates",
    8: "image_url description denomination city address",
    9: "image_url description denomination city address religion",
    10: "image_url description denomination city address religion coordinates",
    11: "image_url description website_url denomination city address religion",
    12: "image_url description website_url denomination city address religion coordinates",
}


def test_published_histogram(spark):
    fields = ("image_url", "description", "website_url", "denomination", "city", "address", "religion")
    rows = []
    for score, n in HISTOGRAM.items():
        has = FILLED[score].split()
        spot = (1.0, 2.0) if "coordinates" in has else (None, 2.0)
        rows += [(*["x" if f in has else None for f in fields], *spot)] * n
    places = spark.createDataFrame(rows, ", ".join(f"{f} string" for f in fields) + ", latitude double, longitude double")
    assert {r.score: r["rows"] for r in score_distribution(places).collect()} == HISTOGRAM
    row = summary(places).first()
    assert (row.total, row.average_score) == (6951, MEAN)


def test_report_sections(tables):
    places = tables("places")
    report = audit_report(places)
    sizes = {name: df.count() for name, df in report.items()}
    assert len(sizes) == 19 and sizes["summary"] == 1 and sizes["missing_fields"] == 10
    assert all(sizes[n] <= 20 for n in ("highest_quality", "lowest_quality", "image_candidates", "duplicates_near"))
    long = report_long(places)
    total = report["summary"].first().total
    for section in ("country", "city", "raw_label", "label", "score"):
        assert long.filter(F.col("section") == section).agg(F.sum("value")).first()[0] == total


def test_the_whole_audit_in_one_table(spark, tables):
    from wayfolio.plans.audit import full_audit

    places = tables("places")
    rows = full_audit(places).collect()
    by_section = {}
    for r in rows:
        by_section.setdefault(r.section, []).append(r)
    report = audit_report(places)
    assert set(by_section) <= {"summary", "missing_fields", *report} and len(set(report)) == 19
    assert {s: len(own) for s, own in by_section.items() if s not in ("summary",)} == {
        s: n for s, df in report.items() if s != "summary" and (n := df.count())
    }
    for own in by_section.values():
        assert sorted(r.rank for r in own) == list(range(1, len(own) + 1))
    summary_row = report["summary"].first()
    figures = {r.key: r.value for r in by_section["summary"]}
    assert figures["total"] == summary_row.total and figures["average_score_hundredths"] == round(100 * summary_row.average_score)
    assert [r.key for r in sorted(by_section["highest_quality"], key=lambda r: r.rank)] == [str(r.id) for r in report["highest_quality"].collect()]
    nothing = {(r.section, r.key): r.value for r in full_audit(places.filter("false")).collect()}
    assert nothing["summary", "total"] == 0 and nothing["missing_fields", "name"] == 0 and len(nothing) == 13
