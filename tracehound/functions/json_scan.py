"""Where JSON objects or array elements begin and end, found block by block.

A file is cut into blocks of text. What a block needs to know of the ones before it is small:
how deep it starts, whether inside a string, and which object is open. So every block first
says what it does to any such state (``ObjectScan.effect``), the effects are applied one after
the other with one short row per block (``carry``), and then every block cuts out its parts on
its own (``ObjectScan.parts``). A part is a whole object, or what one block has of an object
that crosses its border.

A string cannot go over a line end. Between objects, a line that does not begin with a brace
is noise and skipped. A brace right after a closing one, without a comma between them, can
only begin the next object: an object that was never closed is given up there. Array files are
read strictly: noise makes them no array.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_STRING_REST = re.compile(r'(?:[^"\\\n]++|\\[^\n])*+')
_SKIP_OBJECT = re.compile(r'(?:[^"{}]++|"(?:[^"\\\n]++|\\[^\n])*+")*+')
_SKIP_ARRAY = re.compile(r'(?:[^"{}\[\],]++|"(?:[^"\\\n]++|\\[^\n])*+")*+')
_BLANK = re.compile(r"[\s,]*+")
_NEXT = re.compile(r"\s*+\{")
_SPACE = re.compile(r"\s*+")


# What a block can start in, besides its depth: the last two only inside an object.
PLAIN, NOISE, QUOTED, CLOSED = "plain", "noise", "quoted", "closed"


@dataclass(frozen=True)
class State:
    """Depth; in a noise line, in a string, or right behind a closing brace; where the open object began."""

    depth: int = 0
    mode: str = PLAIN
    opened: tuple[int, int] | None = None


@dataclass(frozen=True)
class Part:
    """``text`` of the object that began at ``opened`` (block, offset)."""

    opened: tuple[int, int]
    text: str
    begins: bool
    ends: bool


def _out_of_string(text: str, at: int) -> tuple[int, bool]:
    """Where the string that covers ``at`` ends, and whether it goes on behind the text."""
    at = _STRING_REST.match(text, at).end()
    if at >= len(text):
        return at, True
    return at + (text[at] == '"'), False


class ObjectScan:
    """Objects one after the other, with noise between them."""

    def __init__(self, block: int, text: str):
        self.block, self.text = block, text
        self._ends: dict[int, State] = {}

    def _token(self, at: int, quoted: bool) -> tuple[int, str, bool]:
        """Next brace outside strings: place behind it, the brace or '', and the string state at the end."""
        text = self.text
        if quoted:
            at, quoted = _out_of_string(text, at)
        while not quoted:
            at = _SKIP_OBJECT.match(text, at).end()
            if at >= len(text):
                return at, "", False
            if text[at] != '"':
                return at + 1, text[at], False
            at, quoted = _out_of_string(text, at + 1)
        return at, "", True

    def _between(self, at: int, noise: bool) -> tuple[int, State | None]:
        """From depth 0 to the place of the next object, or the state at the end."""
        text = self.text
        while True:
            if noise:
                at = text.find("\n", at)
                if at < 0:
                    return len(text), State(0, NOISE)
            at = _BLANK.match(text, at).end()
            if at >= len(text):
                return at, State()
            if text[at] == "{":
                return at, None
            noise = True

    def _from_zero(self, at: int) -> State:
        """State at the end of the block when there is no open object at ``at``."""
        seen = []
        while at not in self._ends:
            seen.append(at)
            start, end = self._between(at, False)
            if end is not None:
                break
            end, at = self._from_object(start)
            if end is not None:
                break
        else:
            end = self._ends[at]
        self._ends.update(dict.fromkeys(seen, end))
        return end

    def _from_object(self, start: int) -> tuple[State | None, int]:
        """State at the end if the object at ``start`` stays open, else the place behind it."""
        depth, at, quoted, closed = 1, start + 1, False, None
        while True:
            at, brace, quoted = self._token(at, quoted)
            if not brace:
                return State(depth, self._mode(quoted, closed), (self.block, start)), at
            if brace == "{":
                depth, closed = depth + 1, None
                continue
            depth, closed = depth - 1, at
            if depth == 0:
                return None, at
            found = _NEXT.match(self.text, at)
            if found:
                depth, start, at, closed = 1, found.end() - 1, found.end(), None

    def _mode(self, quoted: bool, closed: int | None) -> str:
        """At the end of the block inside an object; ``closed`` is the place behind the last brace if it closed."""
        if quoted:
            return QUOTED
        return CLOSED if closed is not None and _SPACE.fullmatch(self.text, closed) else PLAIN

    def effect(self) -> dict:
        """What the block does to every state it can start in."""
        start, end = self._between(0, True)
        out = {"lines": self.text.count("\n"), "between": self._from_zero(0), NOISE: end or self._from_zero(start)}
        for mode in (PLAIN, QUOTED, CLOSED):
            # behind[d]: the state at the end when the object is closed d + 1 levels up
            behind, level, at, quoted, closed, rest = [], 0, 0, mode == QUOTED, None, None
            if mode == CLOSED:
                closed, found = 0, _NEXT.match(self.text)
                rest = found and self._from_zero(found.end() - 1)
            while rest is None:
                at, brace, quoted = self._token(at, quoted)
                if not brace:
                    rest = (level, self._mode(quoted, closed))
                elif brace == "{":
                    level, closed = level + 1, None
                else:
                    level, closed = level - 1, at
                    if level < -len(behind):
                        behind.append(self._from_zero(at))
                    found = _NEXT.match(self.text, at)
                    rest = found and self._from_zero(found.end() - 1)
            out[mode] = (behind, rest)
        return out

    @staticmethod
    def after(effect: dict, state: State) -> State:
        if state.depth == 0:
            return effect[NOISE if state.mode == NOISE else "between"]
        behind, rest = effect[state.mode]
        if state.depth <= len(behind):
            return behind[state.depth - 1]
        if isinstance(rest, State):
            return rest
        return State(state.depth + rest[0], rest[1], state.opened)

    def parts(self, state: State) -> list[Part]:
        """The objects, whole or in part, of a block that starts in ``state``."""
        out, text = [], self.text
        depth, at, quoted, opened, start = state.depth, 0, state.mode == QUOTED, state.opened, 0
        found = _NEXT.match(text) if state.mode == CLOSED else None
        if depth == 0:
            at, end = self._between(0, state.mode == NOISE)
            if end is not None:
                return out
            found = _NEXT.match(text, at)
        while True:
            if found:
                depth, start, at = 1, found.end() - 1, found.end()
                opened, found = (self.block, start), None
            at, brace, quoted = self._token(at, quoted)
            if not brace:
                out.append(Part(opened, text[start:], opened[0] == self.block, False))
                return out
            depth += 1 if brace == "{" else -1
            if depth == 0:
                out.append(Part(opened, text[start:at], opened[0] == self.block, True))
                at, end = self._between(at, False)
                if end is not None:
                    return out
                found = _NEXT.match(text, at)
            elif brace == "}":
                found = _NEXT.match(text, at)


class ArrayScan:
    """Elements of one array: text between brackets, cut at commas of depth 1."""

    def __init__(self, block: int, text: str):
        self.block, self.text = block, text

    def _tokens(self, quoted: bool):
        text, at = self.text, 0
        if quoted:
            at, quoted = _out_of_string(text, 0)
        while not quoted:
            at = _SKIP_ARRAY.match(text, at).end()
            if at >= len(text):
                break
            if text[at] == '"':
                at, quoted = _out_of_string(text, at + 1)
                continue
            yield at, text[at]
            at += 1
        self.quoted = quoted

    def effect(self) -> dict:
        out = {"lines": self.text.count("\n")}
        for mode in (PLAIN, QUOTED):
            level, commas, begun = 0, {}, False
            for _, c in self._tokens(mode == QUOTED):
                begun = True
                if c == ",":
                    commas[level] = commas.get(level, 0) + 1
                else:
                    level += 1 if c in "{[" else -1
            out[mode] = (level, QUOTED if self.quoted else PLAIN, commas, begun)
        return out

    @staticmethod
    def after(effect: dict, state: State) -> State:
        """``opened`` counts the commas between elements once the array has begun."""
        level, mode, commas, begun = effect[state.mode]
        index = (state.opened or (0, 0))[1] + commas.get(1 - state.depth, 0)
        return State(state.depth + level, mode, (0, index) if begun else state.opened)

    def parts(self, state: State) -> list[Part]:
        """Elements by index; text outside the array comes as an element of index -1."""
        out, depth, start, text = [], state.depth, 0, self.text
        index, begins = (state.opened or (0, 0))[1], False

        def outside(piece: str) -> None:
            if not _SPACE.fullmatch(piece):
                out.append(Part((0, -1), piece, True, True))

        for at, c in self._tokens(state.mode == QUOTED):
            if depth == 0:
                outside(text[start:at])
                if c != "[" or state.opened is not None or begins or out:
                    out.append(Part((0, -1), c, True, True))
                begins, start = True, at + 1
            elif depth == 1 and c in ",]}":
                out.append(Part((0, index), text[start:at], begins, True))
                if c == "}":
                    out.append(Part((0, -1), c, True, True))
                index, start, begins = index + 1, at + 1, True
            if c != ",":
                depth += 1 if c in "{[" else -1
        if depth == 0:
            outside(text[start:])
        else:
            out.append(Part((0, index), text[start:], begins, False))
        return out


def carry(scan: type, effects: list[dict]) -> tuple[list[tuple[State, int]], State]:
    """The state and the number of line ends before each block, and the state at the end."""
    state, lines, out = State(), 0, []
    for effect in effects:
        out.append((state, lines))
        state, lines = scan.after(effect, state), lines + effect["lines"]
    return out, state
