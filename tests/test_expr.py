"""Expressions: building, reading, writing."""

import random

import pytest

from larkspur.expr import Expr, Sym, from_json, q, read_all, read_path, read_sexpr, s, to_json, write_sexpr


def test_building_and_equality():
    assert q.Plus(1, s.x) == Expr("Plus", (1, Sym("x")))
    assert s.x + 1 == q.Plus(s.x, 1) and 1 - s.x == q.Minus(1, s.x) and (s.x > 2) == q.Greater(s.x, 2)
    assert (s.x < 2) == q.Greater(2, s.x) and (s.x > 1) & (s.y > 2) == q.And(q.Greater(s.x, 1), q.Greater(s.y, 2))
    assert q.f(s.x) * 2 / 3 == q.Divide(q.Times(q.f(s.x), 2), 3)


def test_sexpr():
    e = read_sexpr('(Select t (Where (Greater "a\\"b" 2.5))) ; the rest is a comment')
    assert e == q.Select(s.t, q.Where(q.Greater('a"b', 2.5)))
    assert read_all("1 -2 1e3 true #f 'x ()") == [1, -2, 1000.0, True, False, Sym("x"), q.List()]
    for bad in ("(a", "a)", "(1 2)", "a b"):
        with pytest.raises(ValueError):
            read_sexpr(bad)


def _random(r, depth=0):
    if depth > 3 or r.random() < 0.3:
        return r.choice([r.randint(-99, 99), r.random(), True, False, "t é\n\"", Sym("name"), ""])
    return Expr(r.choice(["Plus", "List", "f"]), tuple(_random(r, depth + 1) for _ in range(r.randint(0, 3))))


def test_round_trips():
    for seed in range(300):
        e = _random(random.Random(seed))
        assert from_json(to_json(e)) == e
        if isinstance(e, Expr) and not any(x == q.List() for x in [e]):
            assert read_sexpr(write_sexpr(e)) == e


def test_path():
    assert read_path("t/:Select/:Where/:Greater/x/3/:::") == read_path("t/:Select/:Where/:Greater/x/3/::/::/::")
    assert read_path("t/:Top/:By/x/::/5") == q.Top(s.t, q.By(s.x), 5)
    with pytest.raises(ValueError):
        read_path("a/b")
