from types import SimpleNamespace

import pytest

from riskloom.session import checkpoint_root


def session(master):
    """A session that has no checkpoint folder yet, as far as the choice of one looks at it."""
    place = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: place[0] if place else None, setCheckpointDir=place.append)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: default))


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_one_process_may_use_its_own_folder(master):
    assert "riskloom-" in checkpoint_root(session(master))


@pytest.mark.parametrize("master", ["local-cluster[2,1,1024]", "yarn", "spark://host:7077"])
def test_clusters_need_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(session(master))
