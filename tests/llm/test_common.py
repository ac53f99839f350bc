"""Shared storage and text batches."""

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import common


def test_staged_tables_are_read_back_and_dropped(spark):
    df = common.stage(spark.range(10).selectExpr("id", "cast(null as string) AS text"))
    assert df.count() == 10 and df.inputFiles()[0].split("/stage-")[0].endswith(common.shared_dir(spark).split(":")[-1])
    assert common.drop_staged(spark) >= 1
    with pytest.raises(Exception):  # noqa: B017  the files are gone
        spark.read.schema(df.schema).parquet(df.inputFiles()[0]).count()


def test_texts_without_a_copy():
    column = pa.array(["aé", None, "", "xyz"])
    for part, want in ((column, ["aé", "", "", "xyz"]), (column.slice(1), ["", "", "xyz"]), (column.slice(4), []), (column.cast(pa.large_string()), ["aé", "", "", "xyz"])):
        data, at = common.utf8(part)
        assert [data[a:b].tobytes().decode() for a, b in zip(at, at[1:], strict=False)] == want


def test_slices_cover_a_batch_in_order():
    rng = np.random.default_rng(0)
    texts = ["x" * int(n) for n in rng.integers(0, 50, 200)] + ["y" * 1000, None]
    batch = pa.RecordBatch.from_pydict({"i": pa.array(range(len(texts))), "text": pa.array(texts)})
    parts = list(common.slices(batch, "text", 100))
    assert [i for p in parts for i in p.column("i").to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= 100 for p in parts)


def test_scratch_keeps_what_it_is_told_to(spark):
    outer = common.stage(spark.range(3))
    with common.scratch(spark) as keep:
        inner = common.stage(spark.range(4))
        kept = keep(inner.selectExpr("id + 1 AS id"))
    assert outer.count() == 3 and sorted(r.id for r in kept.collect()) == [1, 2, 3, 4]
    with pytest.raises(Exception):  # noqa: B017  the files are gone
        spark.read.schema(inner.schema).parquet(*[f.rsplit("/", 1)[0] for f in inner.inputFiles()][:1]).count()


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
