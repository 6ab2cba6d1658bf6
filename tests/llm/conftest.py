import pytest

SCHEMA = "text string, doc_id long, lang string, source string, n_chars long, shard string, node string, comp string, bucket string, start string"


def table(spark, texts, ids=None, sources=None, langs=None):
    """Documents with columns whose names the operators use inside, in another order."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(t, i, (langs or ["en"] * len(texts))[k], (sources or [f"s{k % 3}"] * len(texts))[k], None if t is None else len(t), "x", "y", "z", "b", "q") for k, (t, i) in enumerate(zip(texts, ids, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def docs(spark):
    return lambda *a, **k: table(spark, *a, **k)
