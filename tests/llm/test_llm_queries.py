import pytest

pytest.importorskip("public_tokenizers")

from strandframe.llm.queries import ORACLES, QUERIES  # noqa: E402
from tests.checks import FOLDER, spark_rows, sql_rows  # noqa: E402


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        assert spark_rows(df) == sql_rows(ORACLES[name])
    else:
        df.collect()
