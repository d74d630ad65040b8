"""Chart parsing of token sequences against a grammar, and their cheapest repairs."""

from __future__ import annotations

from functools import lru_cache
from itertools import product

from pagemill.llm.repair import Repairer


class Grammar:
    """Rules without empty right-hand sides; a symbol without rules is a terminal.

    Written one rule a line, ``name -> a b | c``. Symbols in ``inline`` stand for terminals alone, and what they stand
    for is written out where they are used, which spares the chart a level.
    """

    def __init__(self, text: str, inline: tuple[str, ...] = ()):
        self.rules: dict[str, list[tuple[str, ...]]] = {}
        for line in text.strip().splitlines():
            if line.strip():
                name, _, right = line.partition(" -> ")
                self.rules.setdefault(name.strip(), []).extend(tuple(alt.split()) for alt in right.split(" | "))
        for name in inline:
            kinds = [alt[0] for alt in self.rules.pop(name)]
            self.rules = {k: [new for alt in alts for new in product(*[kinds if x == name else [x] for x in alt])] for k, alts in self.rules.items()}
        self.accepts = lru_cache(maxsize=100_000)(self._accepts)
        self._repaired = lru_cache(maxsize=20_000)(self._repair)
        self._repairer: Repairer | None = None

    def _accepts(self, start: str, tokens: tuple[str, ...]) -> bool:
        """Whether ``start`` derives the tokens (Earley's chart, no edits)."""
        rules = self.rules
        chart: list[dict] = [{} for _ in range(len(tokens) + 1)]  # item -> None, in order
        waiting: list[dict[str, list]] = [{} for _ in chart]
        for r in rules[start]:
            chart[0][start, r, 0, 0] = None
        for at in range(len(chart)):
            here, wait = chart[at], waiting[at]
            todo = list(here)
            done = set()
            while todo:
                item = todo.pop()
                name, right, dot, origin = item
                if dot == len(right):
                    if (name, origin) in done:
                        continue
                    done.add((name, origin))
                    for n2, r2, d2, o2 in waiting[origin].get(name, ()):
                        new = (n2, r2, d2 + 1, o2)
                        if new not in here:
                            here[new] = None
                            todo.append(new)
                    continue
                symbol = right[dot]
                if symbol in rules:
                    known = wait.get(symbol)
                    if known is None:
                        wait[symbol] = [item]
                        for r in rules[symbol]:
                            new = (symbol, r, 0, at)
                            if new not in here:
                                here[new] = None
                                todo.append(new)
                    else:
                        known.append(item)
                elif at < len(tokens) and symbol == tokens[at]:
                    chart[at + 1][name, right, dot + 1, origin] = None
        return any((start, r, len(r), 0) in chart[-1] for r in rules[start])

    def repair(self, start: str, tokens: tuple[str, ...]) -> tuple[int, tuple[int, ...]]:
        """The least number of edits (insert, delete, replace a token) after which ``start`` derives the tokens, and the
        token positions of such edits, in order."""
        return (self._repaired if len(tokens) <= 64 else self._repair)(start, tokens)  # long ones are seldom met twice

    def _repair(self, start: str, tokens: tuple[str, ...]) -> tuple[int, tuple[int, ...]]:
        if self._repairer is None:
            self._repairer = Repairer(self.rules)
        return self._repairer.repair(start, tokens)
