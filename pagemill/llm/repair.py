"""Cheapest repairs of token sequences of any length and cost, exact.

Apart from one rule a grammar, which stands inside itself between two tokens (``bin ? expr : cond``, ``lambda params : expr``),
the grammars recur at their left or right ends only. All the rest is therefore a finite automaton, and that rule is a call with a
return. With the calls written out down to some depth, the cheapest repair within that depth takes one pass over the tokens.
It is the cheapest of all once no deeper one can cost less, for which there are two bounds; else a search in order of cost is
tried, which is quick where few edits are needed, and then the depth is doubled.
"""

from __future__ import annotations

from functools import cache

import numpy as np

CALL = "<call>"
_FAR = np.int32(1 << 28)
#: costs kept between tokens and sequences, which only save time, are forgotten beyond so many numbers
_KEPT = 1_000_000
#: a search by cost is given up beyond so many states, for automata of more depth, which give the same
_MET = 500_000
#: in lower bounds, an edit costs so much, so that prices can be parts of an edit
_UNIT = 12

Rules = dict[str, list[tuple[str, ...]]]


class Machine:
    """A deterministic automaton: ``moves[state][kind]``, final states; state 0 begins."""

    def __init__(self, moves: list[dict[str, int]], final: set[int]):
        self.moves, self.final = moves, final
        self.returns = sorted({m[CALL] for m in moves if CALL in m})


def _reached(rules: Rules, calls: dict[tuple[str, int, int], str]) -> dict[str, set[str]]:
    """For each symbol, the symbols that stand in what it derives, calls left out."""
    direct = {a: {x for r, right in enumerate(alts) for i, x in enumerate(right) if x in rules and (a, r, i) not in calls} for a, alts in rules.items()}
    out: dict[str, set[str]] = {}
    for a in rules:
        seen: set[str] = set()
        todo = list(direct[a])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo.extend(direct[x])
        out[a] = seen
    return out


def calls_of(rules: Rules) -> dict[tuple[str, int, int], str]:
    """(symbol, rule, place) of what recurs between two tokens, and the symbol called there."""
    reached = _reached(rules, {})
    calls = {
        (a, r, i): x
        for a, alts in rules.items() for r, right in enumerate(alts) for i, x in enumerate(right)
        if 0 < i < len(right) - 1 and x in rules and (x == a or a in reached[x])
    }
    if len(set(calls.values())) > 1:
        raise ValueError(f"more than one symbol recurs inside itself: {sorted(set(calls.values()))}")
    return calls


def machine(rules: Rules, calls: dict[tuple[str, int, int], str], start: str, made: dict[str, Machine]) -> Machine:
    """The smallest automaton for ``start`` over its tokens and CALL; ``made`` keeps those of the symbols it stands on."""
    if start in made:
        return made[start]
    reached = _reached(rules, calls)
    edges: list[list[tuple[str | None, int]]] = [[]]  # state 0 ends; None is a move without a token
    entries: dict[tuple[str, int], int] = {}
    todo: list[tuple[str, int, int]] = []

    def state() -> int:
        edges.append([])
        return len(edges) - 1

    def entry(symbol: str, then: int) -> int:
        if (symbol, then) not in entries:
            entries[symbol, then] = state()
            if symbol == start or start in reached[symbol]:
                todo.append((symbol, then, entries[symbol, then]))
            else:
                part = machine(rules, calls, symbol, made)
                own = [entries[symbol, then], *(state() for _ in part.moves[1:])]
                for s, row in zip(own, part.moves):
                    edges[s].extend((kind, own[to]) for kind, to in row.items())
                for s in part.final:
                    edges[own[s]].append((None, then))
        return entries[symbol, then]

    first = entry(start, 0)
    while todo:
        symbol, then, begin = todo.pop()
        left = [right and right[0] == symbol for right in rules[symbol]]
        done = then
        if any(left):  # a loop behind the whole
            done = state()
            edges[done].append((None, then))
        for r, right in enumerate(rules[symbol]):
            at = done
            for i in range(len(right) - 1, 0 if left[r] else -1, -1):
                x = right[i]
                if (symbol, r, i) in calls or x not in rules:
                    new = state()
                    edges[new].append((CALL if x in rules else x, at))
                    at = new
                else:
                    if (x == symbol or symbol in reached[x]) and (i < len(right) - 1 or any(left)):
                        raise ValueError(f"{symbol} recurs at both ends")
                    at = entry(x, at)
            edges[done if left[r] else begin].append((None, at))

    @cache
    def closure(begin: int) -> frozenset[int]:
        seen, more = {begin}, [begin]
        while more:
            for kind, to in edges[more.pop()]:
                if kind is None and to not in seen:
                    seen.add(to)
                    more.append(to)
        return frozenset(s for s in seen if s == 0 or any(k is not None for k, _ in edges[s]))

    def closed(states: set[int]) -> frozenset[int]:
        return frozenset().union(*map(closure, states))

    sets = {closed({first}): 0}
    queue, moves = list(sets), []
    for s in queue:
        by: dict[str, set[int]] = {}
        for x in s:
            for kind, to in edges[x]:
                if kind is not None:
                    by.setdefault(kind, set()).add(to)
        row = {}
        for kind, to in by.items():
            c = closed(to)
            if c not in sets:
                sets[c] = len(sets)
                queue.append(c)
            row[kind] = sets[c]
        moves.append(row)
    final = {i for i, s in enumerate(queue) if 0 in s}
    # states that behave alike are one
    group = [int(i in final) for i in range(len(moves))]
    while True:
        keys: dict[tuple, int] = {}
        new = [keys.setdefault((group[i], tuple(sorted((k, group[t]) for k, t in row.items()))), len(keys)) for i, row in enumerate(moves)]
        if len(keys) == len(set(group)):
            break
        group = new
    merged: list[dict[str, int]] = [{} for _ in range(max(group) + 1)]
    order: dict[int, int] = {}
    for i in range(len(moves)):
        order.setdefault(group[i], len(order))
    for i, row in enumerate(moves):
        merged[order[group[i]]] = {k: order[group[t]] for k, t in row.items()}
    made[start] = Machine(merged, {order[group[i]] for i in final})
    return made[start]


class _Flat:
    """An automaton with its calls written out down to a depth, and the costs to the end of a sequence from each state.

    With ``price``, what lies deeper is let in without regard to which return belongs to which call: more than the grammar
    allows, so that the least cost, here in parts of an edit, is a lower bound. Such a call costs ``price`` and such a return
    brings it back, which leaves every true sequence as it is and makes calls, or returns, without their counterpart dear.
    """

    def __init__(self, top: Machine, called: Machine | None, depth: int, price: int | None = None):
        free: list[tuple[int, int, int]] = []  # moves without a token: (from, to, cost)
        marked: list[tuple[int, str, int]] = [(s, k, t) for s, row in enumerate(top.moves) for k, t in row.items() if k != CALL]
        n, size = len(top.moves), len(called.moves) if called else 0
        self.ends = sorted(top.final)
        for back in top.returns:
            for level in range(depth):
                base, outer = n + level * size, n + (level - 1) * size
                marked += [(base + s, k, base + t) for s, row in enumerate(called.moves) for k, t in row.items() if k != CALL]
                for s, row in enumerate(top.moves if level == 0 else called.moves):
                    if CALL in row and (level > 0 or row[CALL] == back):
                        free.append((s if level == 0 else outer + s, base, 0))
                for s in called.final:
                    free += [(base + s, back, 0)] if level == 0 else [(base + s, outer + t, 0) for t in called.returns]
                if price is not None and level == depth - 1:
                    free += [(base + s, base, price) for s, row in enumerate(called.moves) if CALL in row]
                    free += [(base + s, base + t, -price) for s in called.final for t in called.returns]
            n += depth * size
        self.n, self.unit = n, np.int32(1 if price is None else _UNIT)
        self.free: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for s, t, cost in free:
            self.free[s].append((t, cost))
        self.marked: list[dict[str, int]] = [{} for _ in range(n)]
        for s, k, t in marked:
            self.marked[s][k] = t
        edits = {(s, t, int(self.unit)) for s, _, t in marked}
        self._any, self._loose = _sorted(edits), _sorted(edits | set(free))
        by: dict[str, set] = {}
        for s, k, t in marked:
            by.setdefault(k, set()).add((s, t, 0))
        self._by = {k: _sorted(v) for k, v in by.items()}
        self._forget()

    def _forget(self) -> None:
        self.vectors: list[np.ndarray] = []
        self._numbers: dict[bytes, int] = {}
        self._steps: dict[tuple[int, str], tuple[int, int]] = {}
        end = np.full(self.n, _FAR, np.int32)
        end[self.ends] = 0
        self._last = self._number(self._settled(end))

    def _settled(self, v: np.ndarray) -> np.ndarray:
        """Costs once tokens may be inserted."""
        while True:
            new = _least(v.copy(), self._loose, v)
            if np.array_equal(new, v):
                return v
            v = new

    def _number(self, v: np.ndarray) -> tuple[int, int]:
        least = int(v.min())
        v = v - np.int32(least)
        key = v.tobytes()
        if key not in self._numbers:
            self._numbers[key] = len(self.vectors)
            self.vectors.append(v)
        return self._numbers[key], least

    def kept(self) -> int:
        return len(self.vectors) * (self.n + 100)

    def costs(self, tokens: tuple[str, ...], places: bool = True) -> tuple[int, list[tuple[int, int]]]:
        """The least cost and, where ``places`` are asked for, (vector, what to add to it) before each token and at the end."""
        number, more = self._last
        out = [(number, more)]
        for kind in reversed(tokens):
            step = self._steps.get((number, kind))
            if step is None:
                v = self.vectors[number]
                if not places and self.kept() > _KEPT:
                    self._forget()
                    number = self._number(v)[0]
                new = _least(v + self.unit, self._any, v)
                if kind in self._by:
                    new = _least(new, self._by[kind], v)
                step = self._steps[number, kind] = self._number(self._settled(new))
            number, more = step[0], more + step[1]
            if places:
                out.append((number, more))
        return int(self.vectors[number][0]) + more, out[::-1]

    def places(self, tokens: tuple[str, ...], costs: list[tuple[int, int]]) -> tuple[int, ...]:
        """The tokens before or at which a cheapest repair edits; what can be kept at the front is kept."""

        def cost(state: int, at: int) -> int:
            number, more = costs[at]
            return int(self.vectors[number][state]) + more

        state, at, out = 0, 0, []
        left = cost(0, 0)
        ends = set(self.ends)
        while left or at < len(tokens) or state not in ends:
            # moves without a token may go on in several states, of which one keeps most
            same, k = [state], 0
            while k < len(same):
                same += [t for t, _ in self.free[same[k]] if t not in same and cost(t, at) == left]
                k += 1
            if not left and at == len(tokens):
                break
            if at < len(tokens):
                kept = [self.marked[s][tokens[at]] for s in same if tokens[at] in self.marked[s]]
                kept = [t for t in kept if cost(t, at + 1) == left]
                if kept:
                    state, at = kept[0], at + 1
                    continue
            out.append(at)
            left -= 1
            for s in same:
                if at < len(tokens):
                    swapped = next((t for t in self.marked[s].values() if cost(t, at + 1) == left), None)
                    if swapped is not None:
                        state, at = swapped, at + 1
                        break
                    if cost(s, at + 1) == left:
                        state, at = s, at + 1
                        break
                added = next((t for t in self.marked[s].values() if cost(t, at) == left), None)
                if added is not None:
                    state = added
                    break
        return tuple(out)


def _sorted(edges: set[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges by the state they leave: those states, where the edges of each begin, where edges lead, and their costs."""
    e = np.array(sorted(edges), np.int32).reshape(-1, 3)
    states, begins = np.unique(e[:, 0], return_index=True)
    return states, begins, e[:, 1], e[:, 2]


def _least(into: np.ndarray, edges: tuple[np.ndarray, ...], v: np.ndarray) -> np.ndarray:
    states, begins, to, cost = edges
    if len(states):
        into[states] = np.minimum(into[states], np.minimum.reduceat(v[to] + cost, begins))
    return into


class Repairer:
    """Cheapest repairs by the rules of one grammar."""

    def __init__(self, rules: Rules):
        self.rules = rules
        self._calls = calls_of(rules)
        self._tops: dict[str, Machine] = {}
        self._called = machine(rules, self._calls, next(iter(self._calls.values())), self._tops) if self._calls else None
        if self._called and len(self._called.returns) > 1:
            raise ValueError("calls inside calls return to more than one state")
        # the tokens right before and behind a call
        self._before = {rules[a][r][i - 1] for a, r, i in self._calls}
        self._behind = {rules[a][r][i + 1] for a, r, i in self._calls}
        if self._before & rules.keys() or self._behind & rules.keys():
            raise ValueError("a call without tokens at its sides")
        self._flats: dict[tuple, _Flat] = {}

    def _flat(self, start: str, depth: int, price: int | None = None) -> _Flat:
        key = (start, depth, price)
        if key not in self._flats:
            made = _Flat(machine(self.rules, self._calls, start, self._tops), self._called, depth, price)
            if depth > 8:
                return made  # rare and large
            self._flats[key] = made
        return self._flats[key]

    def repair(self, start: str, tokens: tuple[str, ...]) -> tuple[int, tuple[int, ...]]:
        """The least number of edits (insert, delete, replace a token) after which ``start`` derives the tokens, and
        the positions of such edits."""
        if sum(f.kept() for f in self._flats.values()) > 2 * _KEPT:
            self._flats.clear()
        depth = 1
        while True:
            flat = self._flat(start, depth)
            cost, costs = flat.costs(tokens)
            if cost <= self._deeper(tokens, depth + 1) or not self._tops[start].returns or self._bounded(start, tokens, depth, cost):
                return cost, flat.places(tokens, costs)
            if depth == 8 and (found := self._searched(start, tokens)):
                return found  # few edits in deep calls
            depth *= 2

    def _searched(self, start: str, tokens: tuple[str, ...]) -> tuple[int, tuple[int, ...]] | None:
        """The same by a search in order of cost, calls as deep as they go; null where it meets too many states."""
        top, called, n = self._tops[start], self._called, len(tokens)
        first, size, backs = len(top.moves), len(called.moves), len(top.returns)
        layer, base = size * backs, 1 << 40  # an item is the place times base, plus the state as in _Flat at any level

        def moves(state: int) -> tuple[list[int], dict[str, int], int]:
            """Moves without a token, and with one: its states lie behind the last number."""
            if state < first:
                row = top.moves[state]
                return ([first + top.returns.index(row[CALL]) * size] if CALL in row else []), row, 0
            level, rest = divmod(state - first, layer)
            back, s = divmod(rest, size)
            own = state - s
            free = [own + layer] if CALL in called.moves[s] else []
            if s in called.final:
                free.append(own - layer + called.returns[0] if level else top.returns[back])
            return free, called.moves[s], own

        came: dict[int, int] = {0: -1}  # item: twice the one before it, plus one for an edit
        frontier, cost = [0], 0
        while True:
            for item in frontier:  # grows by what costs nothing more
                at, state = divmod(item, base)
                if at == n and state in top.final:
                    places = []
                    while (before := came[item]) >= 0:
                        item, edit = divmod(before, 2)
                        if edit:
                            places.append(item // base)
                    return cost, tuple(places[::-1])
                free, row, own = moves(state)
                new = [at * base + t for t in free]
                if at < n and tokens[at] in row:
                    new.append((at + 1) * base + own + row[tokens[at]])
                for x in new:
                    if x not in came:
                        came[x] = 2 * item
                        frontier.append(x)
            after: list[int] = []
            for item in reversed(frontier):
                at, state = divmod(item, base)
                _, row, own = moves(state)
                new = [item - state + own + t for k, t in row.items() if k != CALL]
                if at < n:
                    new += [x + base for x in new] + [item + base]
                for x in new:
                    if x not in came:
                        came[x] = 2 * item + 1
                        after.append(x)
                if len(came) > _MET:
                    return None
            frontier, cost = after, cost + 1

    def _bounded(self, start: str, tokens: tuple[str, ...], depth: int, cost: int) -> bool:
        """Whether a lower bound reaches the cost; as the bound is concave in the price, the best price is searched for."""
        bounds: dict[int, int] = {}

        def bound(price: int) -> int:
            if price not in bounds:
                bounds[price] = self._flat(start, depth, price).costs(tokens, False)[0]
            return bounds[price]

        enough = (cost - 1) * _UNIT  # above it, no whole number of edits below the cost is left
        low, high = -_UNIT, _UNIT
        while low < high:
            middle = (low + high) // 2
            if max(bound(middle), bound(middle + 1)) > enough:
                return True
            if bound(middle) < bound(middle + 1):
                low = middle + 1
            else:
                high = middle
        return bound(low) > enough

    def _deeper(self, tokens: tuple[str, ...], depth: int) -> int:
        """What a repair with ``depth`` calls inside each other costs at least: they begin before some place and end
        behind it, and tokens for that which are not there are edits."""
        begun, ending = 0, sum(t in self._behind for t in tokens)
        least = max(0, depth - begun) + max(0, depth - ending)
        for t in tokens:
            begun += t in self._before
            ending -= t in self._behind
            least = min(least, max(0, depth - begun) + max(0, depth - ending))
        return least
