from __future__ import annotations

from types import SimpleNamespace

import pytest

from quasi.session import shared_dir


def test_clusters_need_a_shared_folder():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))
