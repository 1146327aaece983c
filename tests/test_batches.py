"""Python steps of the catalog hold few whole texts at a time, whatever a task has."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuskit.catalog.inputs import Inputs
from corpuskit.session import ROWS_AT_A_TIME
from tests.conftest import SF

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("rows", [2_000, 20_000])
def test_rows_at_a_time(spark, rows):
    spark.conf.unset(BATCH)
    Inputs(spark, SF)

    @F.pandas_udf("int")
    def held(ids: pd.Series) -> pd.Series:
        return pd.Series([len(ids)] * len(ids))

    assert spark.range(0, rows, 1, 1).select(F.max(held("id"))).first()[0] <= ROWS_AT_A_TIME


def test_a_users_value_stays(spark):
    spark.conf.set(BATCH, "1234")
    Inputs(spark, SF)
    assert spark.conf.get(BATCH) == "1234"
    spark.conf.unset(BATCH)
