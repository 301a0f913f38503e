import pytest

from regiometra.llm import memory


def test_functions_keep_their_results_arguments_and_errors(monkeypatch):
    given = []
    monkeypatch.setattr(memory, "give_back", lambda: given.append(1))
    assert memory.giving_back(lambda frame: frame + 1)(1) == 2
    assert memory.giving_back(lambda left, right: (left, right))(1, 2) == (1, 2)
    assert list(memory.batches_giving_back(lambda batches: (b * 2 for b in batches))(iter([1, 2]))) == [2, 4]
    with pytest.raises(ZeroDivisionError):
        memory.giving_back(lambda frame: 1 / frame)(0)
    assert len(given) == 4


def test_memory_can_be_given_back():
    memory.give_back()
