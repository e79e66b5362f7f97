from hypothesis import given
from hypothesis import strategies as st

from webloom.functions.quadtree import QuadTree, Region
from webloom.operators.layout import place_all, tightened

regions = st.builds(Region, st.integers(-8, 8), st.integers(-8, 8), st.integers(1, 12), st.integers(1, 12))
BOUNDS = Region(-10, -10, 24, 24)


def add(new, old):
    return new + old


def tree(fills):
    q = QuadTree(BOUNDS, 0, add)
    for v, r in fills:
        q.fill(v, r)
    return q


fills = st.lists(st.tuples(st.integers(1, 3), regions), max_size=5)


@given(regions)
def test_quarters_are_disjoint_and_complete(r):
    if (r.w, r.h) == (1, 1):
        assert all(q.empty for q in r.quarters())
    else:
        assert sorted(p for q in r.quarters() for p in q.points()) == sorted(r.points())
        assert all(r.contains(q) for q in r.quarters() if not q.empty)


@given(regions, regions)
def test_meet(a, b):
    assert a.meet(a) == a
    assert a.meet(b) == b.meet(a)
    m = a.meet(b)
    assert set(m.points() if m else []) == set(a.points()) & set(b.points())


@given(regions, regions)
def test_hull(a, b):
    h = a.hull(b)
    assert h.contains(a) and h.contains(b) and h == b.hull(a)
    assert a.hull(Region(0, 0, 0, 0)) == a


@given(fills)
def test_every_point_sums_its_fills(f):
    q = tree(f)
    for x, y in [(-10, -10), (0, 0), (3, -2), (13, 13)]:
        assert q.at(x, y) == sum(v for v, r in f if r.holds(x, y))


@given(fills, regions)
def test_hits(f, r):
    assert bool(tree(f).hits(r)) == any(r.meet(x) and BOUNDS.meet(x) and r.meet(x).meet(BOUNDS) for _, x in f)


@given(regions)
def test_tight(r):
    q = QuadTree(BOUNDS, 0, add).fill(1, r)
    assert q.tight(bool) == (r.meet(BOUNDS) or Region(0, 0, 0, 0))


@given(fills, st.integers(-10, 13), st.integers(-10, 13))
def test_insert_adds_at_one_point(f, x, y):
    before = dict(p for r, v in tree(f).tiles() for p in [(q, v) for q in r.points()])
    after = dict(p for r, v in tree(f).insert(5, x, y).tiles() for p in [(q, v) for q in r.points()])
    assert {p for p in after if after[p] != before[p]} == {(x, y)}
    assert after[x, y] == before[x, y] + 5


@given(fills, regions)
def test_cut(f, r):
    q = tree(f)
    if part := r.meet(BOUNDS):
        c = q.cut(part)
        assert all(c.at(x, y) == q.at(x, y) for x, y in part.points())


def test_two_by_two_adds_four():
    q = QuadTree(Region(0, 0, 4, 4), 0, add).fill(1, Region(1, 1, 2, 2))
    assert sum(q.weighted()) == 4 and sum(q.points().values()) == 4
    assert q.show(str) == "0000\n0110\n0110\n0000"
    assert q.tightened(bool).bounds == Region(1, 1, 2, 2)
    assert q.moved(lambda r: r._replace(x=10)).at(11, 1) == 1


def test_tightened():
    assert tightened([]) == []
    out = tightened([Region(0, 0, 5, 18), Region(0, 100, 5, 18), Region(0, 110, 5, 18)])
    assert [r.y for r in out] == [0, 18, 36]


@given(st.lists(st.builds(Region, st.integers(0, 300), st.integers(0, 200), st.integers(1, 90), st.integers(1, 30)), max_size=25))
def test_placed_boxes_never_overlap(rs):
    out = list(place_all(list(enumerate(rs)), 400).values())
    assert all(a.meet(b) is None for i, a in enumerate(out) for b in out[:i])
    assert len(out) >= bool(rs)
