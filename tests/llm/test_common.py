from types import SimpleNamespace

import pytest

from tarn.llm.common import Staged, shared_dir


def test_no_local_folder_on_a_cluster():
    conf = SimpleNamespace(get=lambda key, default: default)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))


def test_only_the_result_stays(spark, tmp_path):
    store = Staged(spark, "t")
    first = store.put(spark.range(5))
    out = store.final(first.repartition(3).groupBy("id").count())
    assert out.count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{store.root}/1").count()
