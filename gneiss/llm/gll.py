"""Generalised LL recognition with a graph-structured stack.

A grammar is written in EBNF; each rule becomes a small automaton over terminals and rules. The recogniser runs all alternatives
that one token of lookahead leaves, side by side: a call of a rule at a place is one node of the stack however many callers wait
for it, and a node that has ended at a place hands that on to callers that come later. So every grammar is accepted, ambiguous and
left-recursive ones included, in at most cubic time, and where one alternative is left it runs like a hand-written parser.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Mapping, Sequence

_EBNF = re.compile(r"\s*(?:'([^']+)'|([A-Za-z_]\w*)|([()|*+?]))")

END = "<end>"


class _Rules:
    """EBNF to automata without empty moves. Rules whose names begin with an underscore are written out where they are used."""

    def __init__(self, text: str, classes: Mapping[str, Iterable[str]]) -> None:
        self.classes = {k: sorted(set(v)) for k, v in classes.items()}
        self.source: dict[str, str] = {}
        name = None
        for line in text.splitlines():
            line = line.split(" ## ")[0].rstrip()
            if not line.strip():
                continue
            if m := re.match(r"([A-Za-z_]\w*):(.*)", line):
                name = m[1]
                if name in self.source:
                    raise ValueError(f"rule {name} stands twice")
                self.source[name] = m[2]
            else:
                self.source[name] += " " + line.strip()
        self.moves: list[list[tuple[str | None, str | None, int]]] = []

    def state(self) -> int:
        self.moves.append([])
        return len(self.moves) - 1

    def parse(self, text: str) -> tuple[int, int]:
        tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _EBNF.match(text, at)
            if not m:
                raise ValueError(f"bad EBNF: {text[at : at + 40]!r}")
            tokens.append(m.groups())
            at = m.end()
        self._tokens, self._at = tokens, 0
        out = self._choice()
        if self._at != len(tokens):
            raise ValueError(f"bad EBNF: {text!r}")
        return out

    def _peek(self) -> str | None:
        return self._tokens[self._at][2] if self._at < len(self._tokens) else ")"

    def _choice(self) -> tuple[int, int]:
        start, end = self.state(), self.state()
        while True:
            a, b = self._sequence()
            self.moves[start].append((None, None, a))
            self.moves[b].append((None, None, end))
            if self._at < len(self._tokens) and self._peek() == "|":
                self._at += 1
                continue
            return start, end

    def _sequence(self) -> tuple[int, int]:
        start = last = self.state()
        while self._at < len(self._tokens) and self._peek() not in ("|", ")"):
            a, b = self._item()
            self.moves[last].append((None, None, a))
            last = b
        return start, last

    def _item(self) -> tuple[int, int]:
        terminal, name, mark = self._tokens[self._at]
        self._at += 1
        if mark == "(":
            a, b = self._choice()
            if self._at >= len(self._tokens) or self._peek() != ")":
                raise ValueError("a bracket is open")
            self._at += 1
        elif mark:
            raise ValueError(f"unexpected {mark}")
        else:
            a, b = self.state(), self.state()
            if terminal:
                self.moves[a].append((terminal, None, b))
            elif name in self.classes:
                for t in self.classes[name]:
                    self.moves[a].append((t, None, b))
            else:
                if name not in self.source:
                    raise ValueError(f"no rule {name}")
                if name[0] == "_":  # written out in place
                    kept = self._tokens, self._at
                    x, y = self.parse(self.source[name])
                    self._tokens, self._at = kept
                    self.moves[a].append((None, None, x))
                    self.moves[y].append((None, None, b))
                else:
                    self.moves[a].append((None, name, b))
        while self._at < len(self._tokens) and self._tokens[self._at][2] in ("*", "+", "?"):
            mark = self._tokens[self._at][2]
            self._at += 1
            x, y = self.state(), self.state()
            self.moves[x].append((None, None, a))
            self.moves[b].append((None, None, y))
            if mark in "*?":
                self.moves[x].append((None, None, y))
            if mark in "*+":
                self.moves[b].append((None, None, a))
            a, b = x, y
        return a, b

    def closure(self, states: Iterable[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for terminal, rule, to in self.moves[todo.pop()]:
                if terminal is None and rule is None and to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)


class _Second:
    """Which tokens can come second, as bit masks; within the rules that are open the context is exact."""

    def __init__(self, shift, call, final, owner, entry, nullable, begins, can_end, follow, number) -> None:
        mask = lambda tokens: sum(1 << number[t] for t in tokens)
        self.begins = [mask(b) for b in begins]
        self.can_end = can_end
        self.follow = {n: mask(f) for n, f in follow.items()}
        self.owner, self.entry, self.nullable = owner, entry, nullable
        self.anything = (1 << len(number)) - 1
        # inside[s][t]: tokens that can follow t within the rule of s; ends[s]: tokens after which the rule can end at once
        self.inside: list[dict[str, int]] = [{} for _ in shift]
        self.ends: list[set[str]] = [set() for _ in shift]
        changed = True
        while changed:
            changed = False
            for s in range(len(shift)):
                inside, ends = self.inside[s], self.ends[s]

                def put(t: str, more: int, end: bool, inside=inside, ends=ends) -> bool:
                    grew = False
                    if inside.get(t, 0) | more != inside.get(t, 0):
                        inside[t] = inside.get(t, 0) | more
                        grew = True
                    if end and t not in ends:
                        ends.add(t)
                        grew = True
                    return grew

                for t, to in shift[s].items():
                    changed |= put(t, self.begins[to], can_end[to])
                for rule, to in call[s].items():
                    e = entry[rule]
                    for t in list(self.inside[e]) + [t for t in self.ends[e] if t not in self.inside[e]]:
                        over = t in self.ends[e]
                        changed |= put(t, self.inside[e].get(t, 0) | (self.begins[to] if over else 0), over and can_end[to])
                    if rule in nullable:
                        for t in list(self.inside[to]) + [t for t in self.ends[to] if t not in self.inside[to]]:
                            changed |= put(t, self.inside[to].get(t, 0), t in self.ends[to])

    def after(self, to: int, s: int) -> int:
        """Second tokens once a token has led to a state."""
        return self.begins[to] | (self.follow[self.owner[s]] if self.can_end[to] else 0)

    def through(self, rule: str, to: int, token: str, s: int) -> int:
        """Second tokens where a rule is called on a token."""
        e, out = self.entry[rule], 0
        out |= self.inside[e].get(token, 0)
        if token in self.ends[e]:
            out |= self.after(to, s)
        if rule in self.nullable:
            out |= self.inside[to].get(token, 0) | (self.follow[self.owner[s]] if token in self.ends[to] or self.can_end[to] else 0)
            if self.can_end[to]:
                out = self.anything
        return out


class Grammar:
    """A compiled grammar: for every state and token what may be done."""

    def __init__(self, text: str, classes: Mapping[str, Iterable[str]], starts: Sequence[str]) -> None:
        rules = _Rules(text, classes)
        # deterministic automata for all rules, in one numbering
        shift: list[dict[str, int]] = []
        call: list[dict[str, int]] = []
        final: list[bool] = []
        owner: list[str] = []
        entry: dict[str, int] = {}
        for name, source in rules.source.items():
            if name[0] == "_":
                continue
            a, b = rules.parse(source)
            first = rules.closure([a])
            number = {first: len(shift)}
            order = [first]
            entry[name] = len(shift)
            for group in (grow := order):
                shift.append({})
                call.append({})
                final.append(b in group)
                owner.append(name)
                targets: dict[tuple[bool, str], set[int]] = defaultdict(set)
                for s in group:
                    for terminal, rule, to in rules.moves[s]:
                        if terminal is not None:
                            targets[True, terminal].add(to)
                        elif rule is not None:
                            targets[False, rule].add(to)
                at = number[group]
                for (is_terminal, label), to in targets.items():
                    next_ = rules.closure(to)
                    if next_ not in number:
                        number[next_] = entry[name] + len(order)
                        grow.append(next_)
                    (shift if is_terminal else call)[at][label] = number[next_]
        names = list(entry)
        nullable: set[str] = set()
        first_of: dict[str, set[str]] = {n: set() for n in names}
        states_of = defaultdict(list)
        for s, n in enumerate(owner):
            states_of[n].append(s)

        def open_states(start: int) -> list[int]:
            """States that are reached without a token."""
            seen, todo = {start}, [start]
            while todo:
                for rule, to in call[todo.pop()].items():
                    if rule in nullable and to not in seen:
                        seen.add(to)
                        todo.append(to)
            return list(seen)

        changed = True
        while changed:
            changed = False
            for n in names:
                reach = open_states(entry[n])
                if n not in nullable and any(final[s] for s in reach):
                    nullable.add(n)
                    changed = True
                got = set().union(*(set(shift[s]).union(*(first_of[r] for r in call[s])) for s in reach))
                if not got <= first_of[n]:
                    first_of[n] |= got
                    changed = True
        follow: dict[str, set[str]] = {n: set() for n in names}
        for s in starts:
            follow[s].add(END)
        begins = [set().union(*(set(shift[x]).union(*(first_of[r] for r in call[x])) for x in open_states(s))) for s in range(len(shift))]
        can_end = [any(final[x] for x in open_states(s)) for s in range(len(shift))]
        changed = True
        while changed:
            changed = False
            for s in range(len(shift)):
                for rule, to in call[s].items():
                    more = begins[to] | (follow[owner[s]] if can_end[to] else set())
                    if not more <= follow[rule]:
                        follow[rule] |= more
                        changed = True

        self.tokens = sorted(set().union(*map(set, shift)) | {END})
        self.number = {t: i for i, t in enumerate(self.tokens)}
        rule_number = {n: i for i, n in enumerate(names)}
        self.rules = len(names)
        second = _Second(shift, call, final, owner, entry, nullable, begins, can_end, follow, self.number)
        #: per state and token: None, a state to shift to, -1 to end the rule, (entry, return state, rule) to call, or, where the next
        #: token decides further, what to do for each of these; a list of alternatives where two tokens leave several
        self.table: list[list] = []
        for s in range(len(shift)):
            row: list = [None] * len(self.tokens)
            for t, i in self.number.items():
                todo: list[tuple[object, int]] = []
                if t in shift[s]:
                    todo.append((shift[s][t], second.after(shift[s][t], s)))
                for rule, to in call[s].items():
                    if t in first_of[rule] or rule in nullable and t in follow[rule]:
                        # a call at the very end of a rule needs no return
                        alone = final[to] and not shift[to] and not call[to]
                        todo.append(((entry[rule], -1 if alone else to, rule_number[rule]), second.through(rule, to, t, s)))
                if final[s] and t in follow[owner[s]]:
                    todo.append((-1, second.anything))
                if len(todo) < 2:
                    row[i] = todo[0][0] if todo else None
                    continue
                row[i] = {}
                for j in range(len(self.tokens)):
                    left = [act for act, mask in todo if mask >> j & 1]
                    if left:
                        row[i][j] = left[0] if len(left) == 1 else left
            self.table.append(row)
        self.entries = {s: entry[s] for s in starts}
        #: Of the last sentence that was rejected, the token that no alternative could take.
        self.furthest = 0

    def encode(self, tokens: Iterable[str]) -> list[int]:
        """Numbers of tokens, with the end; -1 for a token that the grammar lacks."""
        get = self.number.get
        return [*(get(t, -1) for t in tokens), self.number[END]]

    def accepts(self, tokens: list[int], starts: Sequence[str] | None = None) -> bool:
        """Whether a list of token numbers is a sentence of any of the start rules, which run together on one stack."""
        if -1 in tokens:
            return False
        table, rules = self.table, self.rules
        end, end_token = len(tokens) - 1, self.number[END]
        root: list = [[], set(), 0]
        nodes: dict[int, list] = {}
        seen: set[tuple[int, int, int]] = set()
        work = [(self.entries[s], root, 0) for s in (starts or self.entries)]
        count, far = 1, 0
        while work:
            state, node, at = work.pop()
            while True:
                act = table[state][tokens[at]]
                if act is None:
                    if at > far:
                        far = at
                    break
                kind = act.__class__
                if kind is dict:
                    act = act.get(tokens[at + 1] if at < end else end_token)
                    if act is None:
                        if at > far:
                            far = at
                        break
                    kind = act.__class__
                if kind is list:
                    key = (state, node[2], at)
                    if key in seen:
                        break
                    seen.add(key)
                    # all but the last alternative wait; each is run as if it were alone
                    for other in act[:-1]:
                        if other.__class__ is int:
                            if other >= 0:
                                work.append((other, node, at + 1))
                            elif node is root:
                                if at == end:
                                    return True
                            elif at not in node[1]:
                                node[1].add(at)
                                for back, parent in node[0]:
                                    work.append((back, parent, at))
                            continue
                        start, back, rule = other
                        if back < 0:
                            work.append((start, node, at))
                            continue
                        place = at * rules + rule
                        callee = nodes.get(place)
                        if callee is None:
                            nodes[place] = callee = [[(back, node)], set(), count]
                            count += 1
                            work.append((start, callee, at))
                        elif not any(b == back and p is node for b, p in callee[0]):
                            callee[0].append((back, node))
                            for there in callee[1]:
                                work.append((back, node, there))
                    act = act[-1]
                    kind = act.__class__
                if kind is int:
                    if act >= 0:
                        state = act
                        at += 1
                        continue
                    if node is root:
                        if at == end:
                            return True
                        break
                    ends = node[1]
                    if at in ends:
                        break
                    ends.add(at)
                    waiting = node[0]
                    for k in range(1, len(waiting)):
                        back, parent = waiting[k]
                        work.append((back, parent, at))
                    state, node = waiting[0]
                    continue
                start, back, rule = act
                if back < 0:
                    state = start
                    continue
                place = at * rules + rule
                callee = nodes.get(place)
                if callee is None:
                    nodes[place] = callee = [[(back, node)], set(), count]
                    count += 1
                    state, node = start, callee
                    continue
                if not any(b == back and p is node for b, p in callee[0]):
                    callee[0].append((back, node))
                    for there in callee[1]:
                        work.append((back, node, there))
                break
        self.furthest = far
        return False
