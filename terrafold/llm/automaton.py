"""Rule expressions to one minimal transition array: parse, subset construction, minimisation; and what reads with it."""

from __future__ import annotations

import numpy as np

#: Separates texts in a scanned stream; no UTF-8 text holds it.
BREAK = 255


class _Parser:
    """Byte expressions: literals, \\xHH, classes, groups, ``|``, ``? * + {n} {n,m}``."""

    def __init__(self, text: str, fold: bool, backward: bool = False):
        self.text, self.at, self.fold, self.backward = text, 0, fold, backward
        self.eps: list[list[int]] = []
        self.move: list[list[tuple[frozenset, int]]] = []
        self.count: dict[int, int] = {}

    def state(self) -> int:
        self.eps.append([])
        self.move.append([])
        return len(self.eps) - 1

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def either(self) -> tuple:
        branches = [self.chain()]
        while self.peek() == "|":
            self.at += 1
            branches.append(self.chain())
        return ("or", branches) if len(branches) > 1 else branches[0]

    def chain(self) -> tuple:
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeat(self.atom()))
        return ("seq", parts)

    def repeat(self, node: tuple) -> tuple:
        while (c := self.peek()) and c in "?*+{":
            if c == "{":
                end = self.text.index("}", self.at)
                low, comma, high = self.text[self.at + 1 : end].partition(",")
                bounds = int(low), int(high) if high else None if comma else int(low)
                self.at = end + 1
            else:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
                self.at += 1
            node = ("rep", node, *bounds)
        return node

    def byte(self) -> int:
        c = self.text[self.at]
        if c == "\\" and self.text[self.at + 1] == "x":
            self.at += 4
            return int(self.text[self.at - 2 : self.at], 16)
        self.at += 2 if c == "\\" else 1
        return ord(self.text[self.at - 1])

    def atom(self) -> tuple:
        if self.peek() == "(":
            self.at += 1
            inner = self.either()
            self.at += 1
            return inner
        if self.peek() == "[":
            self.at += 1
            chosen: set[int] = set()
            while self.peek() != "]":
                low = self.byte()
                high = low
                if self.peek() == "-" and self.text[self.at + 1] != "]":
                    self.at += 1
                    high = self.byte()
                chosen |= set(range(low, high + 1))
            self.at += 1
            return ("set", self.folded(chosen))
        return ("set", self.folded({self.byte()}))

    def folded(self, chosen: set[int]) -> frozenset:
        if self.fold:
            chosen = chosen | {ord(chr(b).swapcase()) for b in chosen if b < 128}
        return frozenset(chosen)

    def whole(self) -> tuple[int, int]:
        """The rule's states. Where it ends in a counted run of one class, ``count`` numbers the run's states:
        a search that is further in the run ends first, so it stands for those behind it."""
        node = self.either()
        end = node[1][-1] if node[0] == "seq" and node[1] else node
        self.last = end if not self.backward and end[0] == "rep" and end[1][0] == "set" and end[2] > 1 else None
        return self.build(node)

    def build(self, node: tuple) -> tuple[int, int]:
        kind, a, z = node[0], self.state(), self.state()
        if kind == "set":
            self.move[a].append((node[1], z))
        elif kind == "seq":
            at = a
            for part in reversed(node[1]) if self.backward else node[1]:
                b, e = self.build(part)
                self.eps[at].append(b)
                at = e
            self.eps[at].append(z)
        elif kind == "or":
            for part in node[1]:
                b, e = self.build(part)
                self.eps[a].append(b)
                self.eps[e].append(z)
        else:
            _, inner, low, high = node
            at = a
            for i in range(low):
                before = len(self.eps)
                b, e = self.build(inner)
                if node is self.last:
                    self.count |= {x: i for x in range(before, len(self.eps)) if self.move[x]}
                self.eps[at].append(b)
                at = e
            if high is None:
                before = len(self.eps)
                b, e = self.build(inner)
                if node is self.last:  # beyond the count: further than all
                    self.count |= {x: low for x in range(before, len(self.eps)) if self.move[x]}
                self.eps[at] += [b, z]
                self.eps[e] += [b, z]
            else:
                for _ in range(high - low):
                    b, e = self.build(inner)
                    self.eps[at] += [b, z]
                    at = e
                self.eps[at].append(z)
        return a, z


def compile_rules(rules: list[tuple[str, bool]], search: bool = True, backward: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``rules``: (expression, whether letters match in either case). ``search``: matches may begin anywhere, else only where reading begins. ``backward``: bytes are read from the last to the first.

    Returns ``step``, ``column`` and ``hits``: with a state's row offset s and a
    byte b, ``step[s + column[b]]`` is the next row offset, and ``hits[state]``
    has bit r set where a match of rule r can end. Where no match can follow any more the state is that without hits which leads to itself only.
    """
    eps: list[list[int]] = []
    move: list[list[tuple[frozenset, int]]] = []
    starts, ends, counts = [], {}, {}
    for r, (text, fold) in enumerate(rules):
        p = _Parser(text, fold, backward)
        a, z = p.whole()
        base = len(eps)
        counts |= {x + base: (r, i) for x, i in p.count.items()}
        eps += [[x + base for x in row] for row in p.eps]
        move += [[(s, x + base) for s, x in row] for row in p.move]
        starts.append(a + base)
        ends[z + base] = r
    sets = sorted({s for row in move for s, _ in row}, key=sorted)
    column, classes = np.zeros(256, np.int64), {}
    for b in range(256):
        column[b] = classes.setdefault(tuple(b in s for s in sets) + (b == BREAK,), len(classes))
    n = len(classes)
    sample = [int(np.flatnonzero(column == c)[0]) for c in range(n)]

    def closed(states: set[int]) -> frozenset:
        todo, out = list(states), set(states)
        while todo:
            for y in eps[todo.pop()]:
                if y not in out:
                    out.add(y)
                    todo.append(y)
        furthest: dict[int, int] = {}
        for r, i in (counts[x] for x in out if x in counts):
            furthest[r] = max(i, furthest.get(r, 0))
        return frozenset(x for x in out if (move[x] or x in ends) and (x not in counts or counts[x][1] == furthest[counts[x][0]]))

    first = closed(set(starts))
    known, rows, queue = {first: 0}, [], [first]
    for here in queue:
        row = []
        for c in range(n):
            b = sample[c]
            there = first if b == BREAK else closed({y for x in here for s, y in move[x] if b in s} | (set(starts) if search else set()))
            if there not in known:
                known[there] = len(known)
                queue.append(there)
            row.append(known[there])
        rows.append(row)
    table = np.array(rows)
    hits = np.array([sum(1 << ends[x] for x in q if x in ends) for q in queue])
    # Minimisation: states stay apart while their hits or the groups they step to differ.
    group, count = np.unique(hits, return_inverse=True)[1], 0
    while count != (count := int(group.max()) + 1):
        group = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)[1].ravel()
    order = np.unique(group, return_index=True)[1]
    rank = np.argsort(np.argsort(order))  # groups in order of first appearance: the start is 0
    group, order = rank[group], np.sort(order)
    step = group[table[order]].astype(np.int32) * n
    return step.ravel(), column.astype(np.int32), hits[order]


#: Bytes that one lane reads; a block of bytes is read by as many lanes side by side as it needs, blocks one after another.
LANE, BLOCK = 2048, 4 << 20


def scan(data: bytes, step: np.ndarray, column: np.ndarray, hits: np.ndarray, once: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``data`` where a match can end, and the rules of each as bits: one step a byte. Of places side by side, the rules ``once`` (bits) have the first only. Memory is that of a block."""
    where, bits, state = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for a in range(0, len(data), BLOCK):
        before = int(hits[state // (int(column.max()) + 1)])
        at, found, state = _scan_block(data[a : a + BLOCK], state, step, column, hits)
        if once and len(at):
            beside = np.where(np.diff(at, prepend=-1) == 1, np.append(before if at[0] == 0 else 0, found[:-1]), 0)
            found = found & ~(beside & once)
            at, found = at[found != 0], found[found != 0]
        where.append(at + a)
        bits.append(found)
    return np.concatenate(where), np.concatenate(bits)


def _scan_block(data: bytes, state: int, step: np.ndarray, column: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """``scan`` of one block from ``state`` on, and the state after it.

    Lanes but the first start in the start state; a lane whose true start differs (the lane
    before ended elsewhere) is read again from there until both ways agree.
    """
    n, size = int(column.max()) + 1, len(data)
    lanes = -(-size // LANE)
    raw = np.full(lanes * LANE, BREAK, np.uint8)
    raw[:size] = np.frombuffer(data, np.uint8)
    cols = np.ascontiguousarray(column[raw].reshape(lanes, LANE).T)
    path = np.empty((LANE, lanes), np.int32)
    at = np.zeros(lanes, np.int32)
    at[0] = state
    for i in range(LANE):
        at = np.take(step, at + cols[i], out=path[i])
    for k in range(1, lanes):
        true, i = int(path[-1, k - 1]), 0
        guess = 0
        while true != guess and i < LANE:
            true = int(step[true + cols[i, k]])
            guess = int(path[i, k])
            path[i, k] = true
            i += 1
    marked = (hits != 0).repeat(n)[path]
    where = np.flatnonzero(marked.T)  # lane after lane
    where = where[where < size]
    return where, hits[path[where % LANE, where // LANE] // n], int(path[(size - 1) % LANE, (size - 1) // LANE])


class Walk:
    """One expression read from a given place on, byte by byte, forward or backward, as far as a match can still come."""

    def __init__(self, text: str, fold: bool, backward: bool = False):
        step, column, hits = compile_rules([(text, fold)], search=False, backward=backward)
        n = int(column.max()) + 1
        self.rows = [[int(x) // n for x in step[i * n : (i + 1) * n]] for i in range(len(hits))]
        self.column, self.good = column.tolist(), [bool(h) for h in hits]
        self.dead = [not g and all(x == i for x in row) for i, (g, row) in enumerate(zip(self.good, self.rows, strict=True))]
        self.by = -1 if backward else 1

    def furthest(self, data: bytes, at: int, limit: int) -> int | None:
        """Where the longest match from ``at`` ends that stays before ``limit`` (after, read backward), or None: the place behind its last byte, or of its first."""
        state, found, by = 0, None, self.by
        while at != limit:
            state = self.rows[state][self.column[data[at if by > 0 else at - 1]]]
            if self.dead[state]:
                break
            at += by
            if self.good[state]:
                found = at
        return found
