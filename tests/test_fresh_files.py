"""Which files of a game are new, without frames being sorted or joined for each game."""

import hashlib

import pandas as pd

from fieldhouse.streaming import ingest


class _State:
    def __init__(self, last=None):
        self.exists, self.get = last is not None, (last,)

    def update(self, value):
        self.exists, self.get = True, value


def test_files_that_repeat_the_last_are_dropped(monkeypatch):
    def never(*a, **k):
        raise AssertionError("a frame was joined or sorted for one game")

    monkeypatch.setattr(pd, "concat", never)
    monkeypatch.setattr(pd.DataFrame, "sort_values", never)
    frame = lambda *rows: pd.DataFrame(rows, columns=["path", "body"])
    state = _State()
    run = lambda *parts: [tuple(r) for out in ingest._fresh(None, iter(parts), state) for r in out.itertuples(index=False)]
    assert run(frame(("c", "x"), ("a", "x")), frame(("b", "x"), ("d", "y"))) == [("a", "x"), ("d", "y")]
    assert run(frame(("e", "y"))) == [] and run(frame(("f", "x"), ("g", "y"))) == [("f", "x"), ("g", "y")]
    assert state.get == (hashlib.sha256(b"y").hexdigest(),)
