"""Time-series queries over recordings.

A recording is rows of samples by position; `files` and `catalog` describe runs
of positions.  Each query has a form over one wide table and, where that differs,
one over runs: the description is filtered, its ranges are gathered, nothing else is read.
"""

from __future__ import annotations

from ..expr import Expr, q, s

#: Positions in one file and in one segment of the stand-in recording.
PER_FILE, PER_SEGMENT = 1000, 100


def samples() -> Expr:
    """The wide table: events as samples of channels at stations."""
    return q.Project(
        q.Table(s.events),
        q.As(s.pos, s.event_id, s.network, "NET", s.channel, s.event_type, s.station, s.user_id, s.seq_no, q.IntDivide(s.event_id, PER_SEGMENT), s.file_key, q.IntDivide(s.event_id, PER_FILE), s.sample_time, s.ts, s.sample_value, s.value),
    )


def _runs(key: Expr, name) -> Expr:
    keyed = q.Project(q.Table(s.events), q.As(name, key, s.pos, s.event_id, s.ts, s.ts))
    return q.Group(keyed, q.By(name), q.As(s.start_time, q.Min(s.ts), s.first, q.Min(s.pos), s.last, q.Max(s.pos)))


def files() -> Expr:
    return q.Project(_runs(q.IntDivide(s.event_id, PER_FILE), s.f_file_key), q.As(s.f_file_key, s.f_file_key, s.f_start, s.first, s.f_end, q.Plus(s.last, 1)))


def catalog() -> Expr:
    """Segments of the recording with the range of positions of each."""
    return q.Project(
        _runs(q.IntDivide(s.event_id, PER_SEGMENT), s.c_seq_no),
        q.As(s.c_seq_no, s.c_seq_no, s.c_file_key, q.IntDivide(s.c_seq_no, PER_FILE // PER_SEGMENT), s.start_time, s.start_time, s.c_start, s.first, s.c_end, q.Plus(s.last, 1)),
    )


def data() -> Expr:
    return q.Project(q.Table(s.events), q.As(s.pos, s.event_id, s.channel, s.event_type, s.station, s.user_id, s.d_file_key, q.IntDivide(s.event_id, PER_FILE), s.d_seq_no, q.IntDivide(s.event_id, PER_SEGMENT), s.sample_time, s.ts, s.sample_value, s.value))


def _within(column, first: str, last: str) -> tuple:
    """Bounds as comparisons of times, both ends out."""
    return q.Greater(column, q.DateObject(first)), q.Greater(q.DateObject(last), column)


def _in_segments(where: Expr) -> Expr:
    """Samples of the segments that a predicate over the catalog picks."""
    picked = q.Project(q.Select(catalog(), q.Where(where)), q.As(s.c_start, s.c_start, s.c_end, s.c_end))
    return q.GatherRanges(data(), "parquet", s.c_start, s.c_end, picked, q.List(s.channel, s.station, s.d_file_key, s.d_seq_no, s.sample_time, s.sample_value))


def m0(channel: str = "click", first: str = "2024-01-03", last: str = "2024-01-05") -> Expr:
    """Sum of samples by station, of one channel, in segments that begin in a window.
    Files and segments are joined; a gathered sample is kept if its file and segment are those picked."""
    picked = q.Select(catalog(), q.Where(q.And(*_within(s.start_time, first, last))))
    picked = q.Project(q.Join(files(), picked, q.Where(q.Equal(s.f_file_key, s.c_file_key))), q.As(s.f_file_key, s.f_file_key, s.c_seq_no, s.c_seq_no, s.c_start, s.c_start, s.c_end, s.c_end))
    sampled = q.GatherRanges(data(), "parquet", s.c_start, s.c_end, picked, q.List(s.channel, s.station, s.d_file_key, s.d_seq_no, s.sample_value), q.Keep(s.f_file_key, s.c_seq_no))
    same = q.And(q.Equal(s.channel, channel), q.Equal(s.f_file_key, s.d_file_key), q.Equal(s.c_seq_no, s.d_seq_no))
    return q.Group(q.Select(sampled, q.Where(same)), q.By(s.station), q.As(s.total, q.Sum(s.sample_value)))


def _sampled(where: Expr, *columns) -> Expr:
    """The other form of a query over the wide table: positions are picked first, then the named columns are gathered by position."""
    at = q.Project(q.Select(samples(), q.Where(where)), q.As(s.a, s.pos, s.b, q.Plus(s.pos, 1)))
    return q.GatherRanges(data(), "parquet", s.a, s.b, at, q.List(*columns))


def m1_gathered(channel: str = "view", station: int = 7, first: str = "2024-01-02", last: str = "2024-01-20") -> Expr:
    where = q.And(q.Equal(s.channel, channel), q.Equal(s.station, station), *_within(s.sample_time, first, last))
    return q.Group(_sampled(where, s.sample_value), q.As(s.total, q.Sum(s.sample_value), s.n, q.Count("*")))


def m2_wide(channel: str = "view", first: str = "2024-01-02", last: str = "2024-01-06", from_: str = "2024-01-03", to: str = "2024-01-05") -> Expr:
    """m2 with the wide table joined to the catalog by segment."""
    picked = q.Project(q.Select(catalog(), q.Where(q.And(*_within(s.start_time, first, last)))), q.As(s.c_seq_no, s.c_seq_no))
    some = q.Select(samples(), q.Where(q.And(q.Equal(s.channel, channel), *_within(s.sample_time, from_, to))))
    return q.Group(q.Join(picked, some, q.Where(q.Equal(s.c_seq_no, s.seq_no))), q.As(s.total, q.Sum(s.sample_value), s.n, q.Count("*")))


def m3_gathered(station: int = 7) -> Expr:
    return q.Group(_sampled(q.Equal(s.station, station), s.channel, s.sample_value), q.By(s.channel), q.As(s.mean, q.Avg(s.sample_value)))


def m4_gathered(station: int = 7) -> Expr:
    return _sampled(q.Equal(s.station, station), s.sample_value, s.sample_time, s.channel)


def m5_gathered(channel: str = "purchase") -> Expr:
    return q.Group(_sampled(q.Equal(s.channel, channel), s.station, s.sample_value), q.By(s.station), q.As(s.mean, q.Avg(s.sample_value), s.total, q.Sum(s.sample_value)))


def m6_wide(first: int = 0, end: int = 720) -> Expr:
    """m6 as a filter on positions."""
    return q.Project(q.Select(samples(), q.Where(q.And(q.Greater(s.pos, first - 1), q.Greater(end, s.pos)))), q.As(s.sample_time, s.sample_time, s.sample_value, s.sample_value))


def m1(channel: str = "view", station: int = 7, first: str = "2024-01-02", last: str = "2024-01-20") -> Expr:
    """Sum of samples of one source in a window of sample times."""
    where = q.And(q.Equal(s.channel, channel), q.Equal(s.station, station), *_within(s.sample_time, first, last))
    return q.Group(q.Select(samples(), q.Where(where)), q.As(s.total, q.Sum(s.sample_value), s.n, q.Count("*")))


def m2(channel: str = "view", first: str = "2024-01-02", last: str = "2024-01-06", from_: str = "2024-01-03", to: str = "2024-01-05") -> Expr:
    """Like m1, over segments that begin in a window of their own."""
    picked = _in_segments(q.And(*_within(s.start_time, first, last)))
    where = q.And(q.Equal(s.channel, channel), *_within(s.sample_time, from_, to))
    return q.Group(q.Select(picked, q.Where(where)), q.As(s.total, q.Sum(s.sample_value), s.n, q.Count("*")))


def m3(station: int = 7) -> Expr:
    """Mean sample of one station by channel."""
    return q.Group(q.Select(samples(), q.Where(q.Equal(s.station, station))), q.By(s.channel), q.As(s.mean, q.Avg(s.sample_value)))


def m4(station: int = 7) -> Expr:
    """The raw samples of one station."""
    return q.Project(q.Select(samples(), q.Where(q.Equal(s.station, station))), q.As(s.sample_value, s.sample_value, s.sample_time, s.sample_time, s.channel, s.channel))


def m5(channel: str = "purchase", network: str = "NET") -> Expr:
    """Mean and sum of samples of one channel by station."""
    where = q.And(q.Equal(s.channel, channel), q.Equal(s.network, network))
    return q.Group(q.Select(samples(), q.Where(where)), q.By(s.station), q.As(s.mean, q.Avg(s.sample_value), s.total, q.Sum(s.sample_value)))


def m6(first: int = 0, end: int = 720) -> Expr:
    """The raw samples of a fixed range of positions."""
    ranges = q.Table(q.a(q.List(first)), q.b(q.List(end)))
    return q.GatherRanges(data(), "parquet", s.a, s.b, ranges, q.List(s.sample_time, s.sample_value))


def m7(first: int = 6336, end: int = 7056) -> Expr:
    """m6 of another range."""
    return m6(first, end)


def m7_wrong_url() -> Expr:
    """A remote table that is not there: evaluation fails, and says so."""
    return q.GatherRanges("/no/such/recording.parquet", "parquet", s.a, s.b, q.Table(q.a(q.List(0)), q.b(q.List(1))), q.List(s.sample_value))
