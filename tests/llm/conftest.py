import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    from corpus import documents

    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    documents(spark).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark):
    from corpus import documents

    return documents(spark, [])
