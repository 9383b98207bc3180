"""Timers of streaming counters, with a stand-in for the state store."""

import pandas as pd

from cairn.streaming import live


class Value:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Handle:
    def __init__(self):
        self.timers, self.value = set(), Value()

    def getValueState(self, name, schema):
        return self.value

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Fired:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at


def rows(*r):
    return iter([pd.DataFrame(r, columns=["seq", "delta", "expire_at_ms"])])


def test_a_later_expiry_takes_the_place_of_an_earlier_one():
    handle, counters = Handle(), live.Counters()
    counters.init(handle)
    assert next(counters.handleInputRows(("k",), rows((1, 2, 100)), None)).value.tolist() == [2]
    assert next(counters.handleInputRows(("k",), rows((2, 3, None)), None)).value.tolist() == [5]
    assert handle.timers == {100}
    assert next(counters.handleInputRows(("k",), rows((4, 1, 900), (3, 1, 50)), None)).value.tolist() == [7]
    assert handle.timers == {900}
    assert list(counters.handleExpiredTimer(("k",), None, Fired(100))) == []
    assert handle.value.exists()
    (gone,) = counters.handleExpiredTimer(("k",), None, Fired(900))
    assert gone.seq.tolist() == [4] and gone.value.isna().all() and not handle.value.exists()
    assert next(counters.handleInputRows(("k",), rows((5, 1, None)), None)).value.tolist() == [1]
