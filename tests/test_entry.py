"""The driver contract without the optional subpackage, or where it can't be imported."""

import sys

import __spark_entry__ as entry


class Refuse:
    """Makes imports of names that begin so fail."""

    def __init__(self, *names):
        self.names = names

    def find_spec(self, name, path=None, target=None):
        if name.startswith(self.names):
            raise ImportError(name)
        return None


def without(monkeypatch, *names):
    for module in [m for m in sys.modules if m.startswith(names)]:
        monkeypatch.delitem(sys.modules, module)
    monkeypatch.setattr(sys, "meta_path", [Refuse(*names), *sys.meta_path])


def test_library_queries_stand_alone(monkeypatch):
    without(monkeypatch, "cohortal.llm", "corpus_pipeline")
    names = set(entry.queries())
    assert len(names) > 150 and "score_and_rank" in names and "read_lines" in names and not any(n.startswith("op") and n[2].isdigit() for n in names)
    assert set(entry.oracle_sql()) <= names


def test_a_missing_library_of_one_operator_leaves_the_rest(monkeypatch):
    without(monkeypatch, "ahocorasick", "cohortal.llm", "corpus_pipeline")
    assert "score_and_rank" in entry.queries()
