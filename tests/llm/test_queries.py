import pytest

from gammaweave.llm.queries import ORACLES, QUERIES
from tests.conftest import DATA, normal


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal(spark, duck, name):
    got, want = QUERIES[name](spark, str(DATA)).toPandas(), duck.sql(ORACLES[name]).df()
    assert normal(got) == normal(want)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_document_has_a_row(spark, name):
    if name == "op12_centroid_clustering":
        pytest.skip("a row for each vector")
    assert QUERIES[name](spark, str(DATA)).count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
