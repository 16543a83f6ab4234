import math

import pytest

from terrane.functions.rules import Equals, IncompatibleRules, Interval, OneOf, merge_rules

#: Three that touch in turn, three that overlap in turn, one within, two with an open end.
A, B, C = Interval(-3, 1.5), Interval(1.5, 8), Interval(8, 20)
D, E, F, G = Interval(-3, 2), Interval(1, 8.5), Interval(7, 20), Interval(-2.5, 0.25)
LEFT, RIGHT = Interval(upper=2.25), Interval(lower=7.5)


@pytest.mark.parametrize(
    ("a", "b", "can"),
    [(A, B, True), (B, C, True), (A, C, False), (D, E, True), (E, F, True), (D, F, False), (A, G, True), (LEFT, B, True), (B, RIGHT, True), (LEFT, RIGHT, False), (Interval(3, 3.5), Interval(-9, math.inf), True), (Interval(3, 3.5), Interval(-math.inf, 31), True)],
)
def test_intervals_merge(a, b, can):
    assert a.can_merge_with(b) is can
    assert b.can_merge_with(a) is can
    if can:
        merged = a.merge_with(b)
        assert merged == b.merge_with(a) == Interval(min(a.lower, b.lower), max(a.upper, b.upper))
        assert merged.contains(a) and merged.contains(b)
    else:
        with pytest.raises(IncompatibleRules):
            a.merge_with(b)


def test_interval_needs_a_bound():
    with pytest.raises(ValueError):
        Interval()


def test_intervals_contain():
    assert A.contains(G) and not G.contains(A) and A.contains(A)
    assert not A.contains(Equals(2)) and not Equals(2).contains(A)


def test_values_merge():
    assert Equals("n").merge_with(Equals("m")) == OneOf({"m", "n"})
    assert Equals(4).merge_with(Equals(4)) == OneOf({4})
    assert OneOf({7, 12}).merge_with(OneOf({3, 30})) == OneOf({3, 7, 12, 30})
    assert OneOf({7, 12}).merge_with(Equals(5)) == Equals(5).merge_with(OneOf({7, 12})) == OneOf({5, 7, 12})
    with pytest.raises(IncompatibleRules):
        Equals(4).merge_with(A)


def test_values_contain():
    assert Equals(4).contains(Equals(4)) and not Equals(4).contains(Equals(5)) and not Equals(4).contains(OneOf({4}))
    assert OneOf({4, 6, 8}).contains(Equals(6)) and OneOf({4, 6, 8}).contains(OneOf({4, 8})) and not OneOf({4, 8}).contains(OneOf({6, 8}))


@pytest.mark.parametrize(
    ("rule", "text"),
    [
        (Interval(6, 9, "age", 0), "6 < age < 9"),
        (Interval(-0.5, 3.25, "age", 1), "-0.5 < age < 3.2"),
        (Interval(7, 8.125, "age"), "7.00 < age < 8.12"),
        (Interval(48000, 51000, "pay", -3), "48000 < pay < 51000"),
        (Interval(lower=11, name="age", precision=0), "age > 11"),
        (Interval(upper=11, name="age", precision=0), "age < 11"),
        (Equals("red", "ink"), "ink = red"),
        (OneOf({"red", "blue"}, "ink"), "ink in {blue, red}"),
    ],
)
def test_text(rule, text):
    assert str(rule) == text


def test_order_and_equality():
    assert sorted([C, A, B]) == [A, B, C]
    assert Interval(4, 6, "a", 1) == Interval(4, 6, "b", 2) and hash(Interval(4, 6, "a")) == hash(Interval(4, 6, "b"))
    assert Equals(5) < OneOf({6, 11}) and OneOf({5, 40}) < Equals(6) and Equals(6) != OneOf({6})


def test_fold_keeps_gaps():
    bins = [Interval(-4, -2), Interval(-2, 0.5), Interval(3, 6), Interval(6, 6.5), Interval(9, 10)]
    assert merge_rules(bins[::-1]) == [Interval(-4, 0.5), Interval(3, 6.5), Interval(9, 10)]
    assert merge_rules([Equals("q"), Equals("p")]) == [OneOf({"p", "q"})]
