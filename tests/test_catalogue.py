import pytest

from sedimark import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_its_sql(name, same):
    same(catalogue.queries()[name], catalogue.oracle_sql()[name])


def test_true_digests_give_the_same_groups(spark, data):
    """Grouping doesn't depend on the hash: BLAKE3 and SHA-256 give the same members."""
    shape = ("size_bytes", "member_count", "observed_path_count", "reclaimable_bytes", "keep_path")
    a, b = (sorted(map(tuple, catalogue.queries()[q](spark, data).select(*shape).collect())) for q in ("blake3_groups", "exact_duplicate_groups"))
    assert a == b and a


def test_every_query_is_over_whole_tables(spark, data):
    plan = catalogue.queries()["size_candidates"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Sample" not in plan and "LocalLimit" not in plan


def test_base64_of_whole_texts(spark, data):
    """Nothing of a text is left out: the longest round trip is that of the longest text."""
    longest = spark.read.parquet(f"{data}/documents.parquet").selectExpr("max(octet_length(text))").first()[0]
    assert longest > 360 and catalogue.queries()["base64_text"](spark, data).agg({"n": "max"}).first()[0] == longest


def test_a_union_has_every_path(spark, data):
    every = {r.path_key for r in catalogue.queries()["observations_projection"](spark, data).select("path_key").collect()}
    found = [r.path_key for r in catalogue.queries()["inventory_union_distinct"](spark, data).collect()]
    assert len(found) == len(every) and set(found) == every
