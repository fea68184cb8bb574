from datetime import datetime

import pytest

from geotrail.functions.intervals import Span, history_spans, visit_span


def d(text):
    return datetime.fromisoformat(text)


@pytest.mark.parametrize(
    "text, lo, hi",
    [
        ("2024", "2024-01-01", "2024-12-31T23:59:59.999999"),
        ("2024-02", "2024-02-01", "2024-02-29T23:59:59.999999"),
        ("2024-02-07", "2024-02-07", "2024-02-07T23:59:59.999999"),
        ("2024-02-07T17", "2024-02-07T17:00:00", "2024-02-07T17:59:59.999999"),
        ("2024-02-07T17:26", "2024-02-07T17:26:00", "2024-02-07T17:26:59.999999"),
        ("2024-02-07T17:26:05", "2024-02-07T17:26:05", "2024-02-07T17:26:05.999999"),
        ("2024-02-07T17:26:05.25", "2024-02-07T17:26:05.25", "2024-02-07T17:26:05.259999"),
        ("2024-02-07T17:26:05.000001Z", "2024-02-07T17:26:05.000001", "2024-02-07T17:26:05.000001"),
        ("2024-02-07T17:26;1m", "2024-02-07T17:26:00", "2024-02-07T17:27:59.999999"),
        ("2018;1M", "2018-01-01", "2019-01-31T23:59:59.999999"),
        ("2018-01;-3d", "2018-01-01", "2018-01-28T23:59:59.999999"),
        ("2024-01-31;1y", "2024-01-31", "2025-01-31T23:59:59.999999"),
    ],
)
def test_single_windows(text, lo, hi):
    assert history_spans(text) == [Span(d(lo), d(hi))]


def test_repeated_windows():
    assert history_spans("2018-01-01;1d;1y;2") == [
        Span(d("2018-01-01"), d("2018-01-02T23:59:59.999999")),
        Span(d("2019-01-01"), d("2019-01-02T23:59:59.999999")),
    ]
    monthly = history_spans("2024-01-31T10;0h;1M;3")
    assert [s.lo for s in monthly] == [
        d("2024-01-31T10:00:00"), d("2024-02-29T10:00:00"), d("2024-03-31T10:00:00"),
    ]


@pytest.mark.parametrize("text", ["", "yesterday", "2024;", "2024;1", "2024;1d;1y", "2024-13"])
def test_nonsense_is_refused(text):
    with pytest.raises(ValueError):
        history_spans(text)


def test_visit_windows():
    assert visit_span("2024-01-05T00:00:00") == Span(d("2024-01-05"), None)
    assert visit_span("2024-01-05T00:00:00;") == Span(d("2024-01-05"), None)
    assert visit_span("2024-01-05T00:00:00;2024-01-06T01:02:03") == Span(
        d("2024-01-05"), d("2024-01-06T01:02:03")
    )
    with pytest.raises(ValueError):
        visit_span("2024-01-05")
