import pytest

from boutlab import session


class _Conf:
    def __init__(self, **values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key.replace(".", "_"), default)


class _Session:
    def __init__(self, **values):
        self.conf = _Conf(**values)


def test_a_cluster_has_to_name_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(_Session(spark_master="spark://host:7077"))
    named = _Session(spark_master="yarn", spark_checkpoint_dir="hdfs://x/y")
    assert session.shared_dir(named) == "hdfs://x/y"
    for master in ("local", "local[*]", "local[8]", "local[2,1]"):
        assert session.shared_dir(_Session(spark_master=master))
    with pytest.raises(ValueError):
        session.shared_dir(_Session(spark_master="local-cluster[2,1,1024]"))
