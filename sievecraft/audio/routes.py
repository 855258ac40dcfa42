"""How the six operators of each arrangement are wired."""

from __future__ import annotations

# fixed values: "modulator>operator" links of arrangements 1 to 32, and the feedback path "from>to"
ROUTES = [
    ("6>5 5>4 4>3 2>1", "6>6"), ("6>5 5>4 4>3 2>1", "2>2"), ("6>5 5>4 3>2 2>1", "6>6"), ("6>5 5>4 3>2 2>1", "4>6"),
    ("6>5 4>3 2>1", "6>6"), ("6>5 4>3 2>1", "5>6"), ("6>5 5>3 4>3 2>1", "6>6"), ("6>5 5>3 4>3 2>1", "4>4"),
    ("6>5 5>3 4>3 2>1", "2>2"), ("6>4 5>4 3>2 2>1", "3>3"), ("6>4 5>4 3>2 2>1", "6>6"), ("6>3 5>3 4>3 2>1", "2>2"),
    ("6>3 5>3 4>3 2>1", "6>6"), ("6>4 5>4 4>3 2>1", "6>6"), ("6>4 5>4 4>3 2>1", "2>2"), ("6>5 4>3 5>1 3>1 2>1", "6>6"),
    ("6>5 4>3 5>1 3>1 2>1", "2>2"), ("6>5 5>4 4>1 3>1 2>1", "3>3"), ("6>5 6>4 3>2 2>1", "6>6"), ("6>4 5>4 3>2 3>1", "3>3"),
    ("6>5 6>4 3>2 3>1", "3>3"), ("6>5 6>4 6>3 2>1", "6>6"), ("6>5 6>4 3>2", "6>6"), ("6>5 6>4 6>3", "6>6"),
    ("6>5 6>4", "6>6"), ("6>4 5>4 3>2", "6>6"), ("6>4 5>4 3>2", "3>3"), ("5>4 4>3 2>1", "5>5"),
    ("6>5 4>3", "6>6"), ("5>4 4>3", "5>5"), ("6>5", "6>6"), ("", "6>6"),
]


def links(algorithm: int) -> list[tuple[int, int]]:
    """(modulator, operator) pairs of an arrangement (from 0); operators are numbered 1 to 6."""
    return [(int(x[0]), int(x[2])) for x in ROUTES[algorithm][0].split()]


def carriers(algorithm: int) -> list[int]:
    """Operators that are heard: those that modulate none."""
    modulators = {m for m, _ in links(algorithm)}
    return [op for op in range(1, 7) if op not in modulators]


def feedback(algorithm: int) -> tuple[int, int]:
    a, b = ROUTES[algorithm][1].split(">")
    return int(a), int(b)


def depth(algorithm: int) -> dict[int, int]:
    """Longest way from each operator down to a carrier."""
    down: dict[int, list[int]] = {}
    for m, op in links(algorithm):
        down.setdefault(m, []).append(op)

    def way(op: int) -> int:
        return 1 + max(map(way, down[op])) if op in down else 0

    return {op: way(op) for op in range(1, 7)}


def columns(algorithm: int) -> list[list[int]]:
    """Operators in stacks: each carrier with what leads to it and to no carrier before it, top first."""
    up: dict[int, list[int]] = {}
    for m, op in links(algorithm):
        up.setdefault(op, []).append(m)
    seen: set[int] = set()
    out = []
    for c in carriers(algorithm):
        stack, todo = [], [c]
        while todo:
            op = todo.pop()
            if op not in seen:
                seen.add(op)
                stack.append(op)
                todo += up.get(op, [])
        out.append(sorted(stack, key=lambda op: (-depth(algorithm)[op], op)))
    return out
