"""Rows that several tests use."""


def cuboid(session, seq, x, y, confidence=0.5, size=1.0, tilt=0.0):
    """A detected zone: a square of points, its outline and a camera above."""
    grid = [(x + i * size / 4, y + j * size / 4) for i in range(5) for j in range(5)]
    points = [{"x": a, "y": b, "z": tilt * a} for a, b in grid]
    outline = [{"x": a, "y": b, "z": tilt * a} for a, b in ((x, y), (x + size, y), (x + size, y + size), (x, y + size))]
    return (session, seq, confidence, points, outline, 0.0, 0.0, 5.0)
