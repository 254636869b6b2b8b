"""Components of a zone, by the small cases that the counting rules are known by."""

from itertools import combinations

import pytest

from parallaxis.operators import triangulate
from parallaxis.operators.triangulate import Component, Zone

LIMITS = {"epsilon": 0.05, "forbidden": 0.1, "min_confidence": 0.0, "radius": 0.03, "conflict_confidence": 0.7, "addition_confidence": 0.5, "component_confidence": 1.5}


def zone(**other):
    return Zone([LIMITS | other] * (triangulate.SETTLED + 1))


def component(z, first_frame, place, confidence=1.0, n=4):
    observations = [(first_frame + k, 0) for k in range(n)]
    pairs = [frozenset(x) for x in combinations(observations, 2)][:4] if n == 4 else [frozenset(x) for x in combinations(observations, 2)]
    c = Component(dict(observations and [(o[0], o) for o in observations]), {p: (place, confidence) for p in pairs})
    c.settle()
    z.components.append(c)
    return c


def test_confidence_is_the_mean_times_the_root_of_the_edges():
    z = zone()
    c = component(z, 0, (1.0, 2.0, 3.0))
    assert c.confidence == pytest.approx(2.0) and c.centre == (1.0, 2.0, 3.0)
    c.edges = {k: (p, x) for (k, (p, _)), x in zip(c.edges.items(), (0.2, 0.4, 0.6, 0.8))}
    c.settle()
    assert c.confidence == pytest.approx(1.0)


def test_weak_components_are_bad():
    z = zone()
    assert z.bad(component(z, 0, (0.0, 0.0, 0.0), 0.7)) and not z.bad(component(z, 10, (0.0, 0.0, 0.0), 0.8))


def test_edges_without_confidence_have_a_plain_mean():
    z = zone()
    c = component(z, 0, (1.0, 1.0, 1.0), 0.0)
    assert c.centre == (1.0, 1.0, 1.0) and c.confidence == 0 and z.bad(c)


def test_a_component_near_the_ray_takes_the_observation_first():
    z = zone()
    c = component(z, 0, (0.0, 0.0, 0.0))
    new = (20, 0)
    z.resolve({frozenset(((0, 0), new)): ((0.0, 0.0, 0.0), 1.0)}, {new: [c]})
    assert len(z.components) == 1 and len(c.members) == 5 and new in c.members.values()


def test_components_at_one_place_dissolve_and_grow_together():
    z = zone()
    a, b = component(z, 0, (0.0, 0.0, 0.0)), component(z, 10, (0.004, 0.0, 0.0))
    z.resolve({frozenset(((0, 0), (10, 0))): ((0.002, 0.0, 0.0), 1.0)}, {})
    assert len(z.components) == 1 and len(z.components[0].members) == 8 and z.components[0] not in (a, b)


def test_audit_dissolves_the_weakest_beyond_the_largest_frame():
    z = zone()
    strong, weak = component(z, 0, (0.0, 0.0, 0.0), 1.0), component(z, 10, (1.0, 0.0, 0.0), 0.8)
    released = z.audit({})
    assert z.components == [strong] and set(released) == set(weak.edges)


def test_one_conflict_is_replaced_by_better_edges_and_two_refuse():
    z = zone()
    c = component(z, 0, (0.0, 0.0, 0.0), 0.75)
    o = (9, 0)
    z.compared = {frozenset((9, k)) for k in range(4)}
    for k in (1, 2, 3):
        z.put(frozenset((o, (k, 0))), ((0.0, 0.0, 0.0), 1.0))
        z.candidates.add(frozenset((o, (k, 0))))
    assert z.forbidden(o, (0, 0)) and z.join(c, o) and 0 not in c.members and 9 in c.members
    d = component(z, 20, (0.0, 0.0, 0.0))
    p = (30, 0)
    z.compared |= {frozenset((30, 20)), frozenset((30, 21))}
    z.put(frozenset((p, (22, 0))), ((0.0, 0.0, 0.0), 1.0))
    assert not z.join(d, p)
    z.ignored.add((p, 20))
    assert not z.forbidden(p, (20, 0)) and z.forbidden(p, (21, 0))


def test_free_edges_are_bounded_between_frames(monkeypatch):
    monkeypatch.setattr(triangulate, "FREE_EDGES", 3)
    z = zone()
    z.accepted = [0]
    for k in range(4):
        z.put(frozenset(((k, 0), (50 + k, 0))), ((float(k), 0.0, 0.0), 0.1 * k))
    z.accepted = list(range(10))
    new = {frozenset(((8, 0), (9, 0))): ((9.0, 0.0, 0.0), 0.25)}
    z.resolve(new, {})
    assert len(z.free) == 3 and frozenset(((8, 0), (9, 0))) in z.free and frozenset(((0, 0), (50, 0))) not in z.free


def test_frames_without_support_are_rejected_after_the_warm_up():
    z = zone()
    ray = {"ox": 0.0, "oy": 0.0, "oz": 1.0, "dx": 0.0, "dy": 0.0, "dz": -1.0}
    assert [z.see(k, {0: ray}, list(range(k)), {}) for k in range(5)] == [True, True, True, False, False]
    assert z.accepted == [0, 1, 2] and not z.see(9, {}, [], {})
