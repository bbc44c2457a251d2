"""The driver's contract without the optional part, and where written tables may go."""

import builtins
import importlib

import pytest

import __spark_entry__
from ebbtide.plans import registry, scratch


def test_queries_do_without_the_training_data_operators(monkeypatch):
    whole = builtins.__import__

    def refuse(name, globals=None, locals=None, fromlist=(), level=0):
        if name == "ebbtide.llm":
            raise ImportError(name, name=name)
        return whole(name, globals, locals, fromlist, level)

    with monkeypatch.context() as m:
        m.setattr(builtins, "__import__", refuse)
        entry = importlib.reload(__spark_entry__)
        assert set(entry.queries()) == set(registry.queries()) and set(entry.oracle_sql()) == set(registry.oracle_sql())
    importlib.reload(__spark_entry__)


def test_a_missing_package_of_an_operator_is_not_hidden(monkeypatch):
    whole = builtins.__import__

    def refuse(name, globals=None, locals=None, fromlist=(), level=0):
        if name == "ebbtide.llm":
            raise ImportError("no tokenizers", name="tokenizers")
        return whole(name, globals, locals, fromlist, level)

    with monkeypatch.context() as m:
        m.setattr(builtins, "__import__", refuse)
        with pytest.raises(ImportError, match="tokenizers"):
            importlib.reload(__spark_entry__)
    importlib.reload(__spark_entry__)


class _Session:
    """A session that names no folder."""

    def __init__(self, master):
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        self.sparkContext = type("Context", (), {"master": master, "getCheckpointDir": staticmethod(lambda: None)})


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://https://host"])
def test_a_cluster_without_a_shared_folder_is_refused(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_folder(_Session(master))
