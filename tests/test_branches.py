"""The queries that are to reach every branch do."""

from tidemark.operators import conflicts as con
from tidemark.plans import branch_rows as rows

SF = "/root/testdata/sf0.001"


def test_every_attribute_and_pattern(spark):
    found = {(r.attribute, r.value) for r in rows.claims_everywhere(spark, SF).collect()}
    assert {a for a, _ in found} == set(con.CLAIMS)
    said = spark.createDataFrame([(i, s) for i, s in enumerate(rows.CLAIMED)], "i int, display_text string")
    got = {(r.attribute, r.value) for r in con.claims(said, rows.BRAND).collect()}
    fixed = {(a, v.replace("{brand}", rows.BRAND.lower())) for a, patterns in con.CLAIMS.items() for _, v in patterns if v not in (None, "bytes")}
    assert fixed <= got
    # The look-ahead stays in its sentence.
    about = {r.i: r.value for r in con.claims(said, rows.BRAND).where("attribute = 'visibility_timeout_default'").collect()}
    assert about[rows.CLAIMED.index("It hides for 90 seconds by default, the visibility of a job.")] == "90" and rows.CLAIMED.index("It runs 90 seconds by default. Its visibility is low.") not in about


def test_every_rule(spark):
    found = rows.rule_cascade(spark, SF).groupBy("order", "rule_fired").count().collect()
    assert {r.rule_fired for r in found if r.order == "given"} == set(con.EXPLAINED)


def test_questions_are_cut(spark):
    found = rows.long_questions(spark, SF)
    assert found.where("chars > 1200").count() < found.count() and found.where("chars = 600 + length('QUESTION: T') + 1 + length('\n\nANSWER (staff, accepted, 9 votes):\nYes.')").count() > 0
