from pathlib import Path

import pytest

from millrace.llm import queries as plans
from sqlcheck import FOLDER, compare


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    compare(spark, plans.queries()[name], plans.oracle_sql()[name])
