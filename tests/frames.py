"""Helpers that several test modules share."""


def as_set(frame):
    rows = [tuple(row) for row in frame.collect()]
    assert len(rows) == len(set(rows)), "repeated rows"
    return set(rows)
