import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from tallygrid.operators.matrix import Matrix  # noqa: E402
from tallygrid.plans.session import ensure_checkpoint_dir, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, partitions=4)
    ensure_checkpoint_dir(session)
    return session


@pytest.fixture(scope="session")
def make(spark):
    """Matrix from dense columns {gene: [values]} and per-cell (type, sample, cond)."""
    def build(dense: dict, labels: list) -> Matrix:
        cells = spark.createDataFrame(
            [(i, *row) for i, row in enumerate(labels)], "cell_id bigint, type string, sample string, cond string")
        rows = [(g, i, float(v)) for g, col in dense.items() for i, v in enumerate(col) if v is not None]
        expr = spark.createDataFrame(rows, "gene string, cell_id bigint, value float")
        genes = spark.createDataFrame([(g, i) for i, g in enumerate(dense)], "gene string, gene_id bigint")
        return Matrix(expr, cells, genes)
    return build
