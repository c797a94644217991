"""Byte-level BPE as a lazily determinised transducer; no Spark in this module.

A sequence of tokens is what the merges produce exactly when every two neighbours stay
apart if merged on their own. So each prefix of a piece has one last token, and reading a
byte only needs the starts whose bytes so far still begin some token that may stand there.
Those starts, with the tokens leading to them, are a state of the transducer. States and arcs are made when
first met and kept; a token leaves as soon as all live starts agree on it, which happens
within the length of the longest token.
"""

from __future__ import annotations

import base64
from array import array
from struct import iter_unpack, pack

import regex

FREE = -1
_NOWHERE = (FREE, FREE)
_LEAF: dict[int, tuple[int, int]] = {}
#: A start with more possible tokens than this counts as open without a look at each.
FEW = 32
_NEVER = 1 << 62
#: What an encoder keeps: states of the transducer, words with their ids.
MAX_STATES, MAX_WORDS = 300_000, 600_000
#: A start of a state: trie node or FREE, index of the start before, token from there.
_START = "=iii"


def ranks_of(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Vocabulary:
    """Ranks as a byte trie."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        children: list[dict[int, int]] = [{}]
        token_at, below = [FREE], [[]]
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            node = 0
            for byte in token:
                following = children[node].get(byte)
                if following is None:
                    following = children[node][byte] = len(children)
                    children.append({})
                    token_at.append(FREE)
                    below.append([])
                if len(below[node]) <= FEW:
                    below[node].append(rank)
                node = following
            token_at[node] = rank
        #: For each trie node and byte: the node below (FREE at a leaf) and its token or FREE.
        self.arcs: list[dict[int, tuple[int, int]]] = []
        for down in children:
            for byte, to in down.items():
                down[byte] = (to if children[to] else FREE, token_at[to])
            self.arcs.append(down or _LEAF)
        #: Tokens strictly below a node, up to one more than FEW.
        self.below = [found or () for found in below]
        self._edges: dict[int, tuple] = {}

    def merges(self, piece: bytes) -> list[list[bytes]]:
        """The parts before each merge and at the end: lowest rank first, leftmost of equals."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        seen = [parts]
        while len(parts) > 1:
            ranked = [
                (self.ranks[parts[i] + parts[i + 1]], i)
                for i in range(len(parts) - 1)
                if parts[i] + parts[i + 1] in self.ranks
            ]
            if not ranked:
                break
            at = min(ranked)[1]
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]
            seen.append(parts)
        return seen

    def merged(self, piece: bytes) -> list[int]:
        """Token ids by applying the merges one by one."""
        return [self.ranks[part] for part in self.merges(piece)[-1]]

    def edges(self, token: int) -> tuple:
        """The token's first and last parts over time, each with the rank of the merge that
        ends it; None for a token that its own merges don't make in order of rank."""
        found = self._edges.get(token, 0)
        if found == 0:
            steps = self.merges(self.tokens[token])
            order = [self.ranks[part] for step in steps[1:] for part in set(step) - set(steps[0])]
            made = [max((self.ranks[p] for p in step if len(p) > 1), default=-1) for step in steps]
            found = None
            if len(steps[-1]) == 1 and made == sorted(made) and max(order, default=-1) <= token:
                first, last = [], []
                for step, then in zip(steps, [*steps[1:], None], strict=True):
                    if then is None or then[0] != step[0]:
                        first.append((step[0], self.ranks[then[0]] if then else _NEVER))
                    if then is None or then[-1] != step[-1]:
                        last.append((step[-1], self.ranks[then[-1]] if then else _NEVER))
                found = (first, last)
            self._edges[token] = found
        return found

    def apart(self, left: int, right: int) -> bool:
        """Do the two tokens stay apart when their bytes are merged together? They don't if
        at some time a part that ends the left one and a part that begins the right one
        merge before either merges with its own side (the leftmost merge wins a tie)."""
        ends, begins = self.edges(left), self.edges(right)
        if ends is None or begins is None:
            return self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        ranks = self.ranks
        for part, until in ends[1]:
            for other, limit in begins[0]:
                across = ranks.get(part + other)
                if across is not None and across < until and across <= limit:
                    return False
        return True


class Transducer:
    """Encodes pieces byte by byte. At most ``max_states`` states are kept; beyond that
    all are forgotten and made again when met, which changes no result."""

    def __init__(self, vocabulary: Vocabulary, max_states: int = MAX_STATES):
        self.vocabulary = vocabulary
        self.max_states = max_states
        #: Answers about pairs, kept beyond the states: fewer where there are fewer states.
        self.max_answers = max_states * 5 // 6
        self._apart: dict[int, bool] = {}
        self._continues: dict[int, bool] = {}
        self._alone: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        start = pack(_START, 0, FREE, FREE)
        self._number = {start: 0}
        self._states = [start]
        #: By state and byte the next state; below 0, the place of next state and tokens.
        self._arcs: dict[int, int] = {}
        self._emitting: list[tuple[int, tuple[int, ...]]] = []
        self._ends: list[tuple[int, ...] | None] = [None]

    def _stays(self, before: int, token: int) -> bool:
        """May the token follow the one before (FREE: begin the piece)?"""
        known = self.vocabulary
        if before == FREE:
            if token not in self._alone:
                self._alone[token] = known.merged(known.tokens[token]) == [token]
            return self._alone[token]
        key = before << 32 | token
        found = self._apart.get(key)
        if found is None:
            if len(self._apart) > self.max_answers:
                self._apart.clear()
            found = self._apart[key] = known.apart(before, token)
        return found

    def _open(self, before: int, node: int) -> bool:
        """May some token that continues these bytes stand here?"""
        below = self.vocabulary.below[node]
        if before == FREE or len(below) > FEW:
            return True
        key = before << 32 | node
        found = self._continues.get(key)
        if found is None:
            if len(self._continues) > self.max_answers:
                self._continues.clear()
            apart = self.vocabulary.apart
            found = self._continues[key] = any(apart(before, token) for token in below)
        return found

    def _arc(self, state: int, byte: int) -> int:
        """A state lists its starts, packed, since very many are kept. A byte moves every live start down the trie; the first start whose bytes are now a
        token that may stand there gives the way to the new end. What no live start
        descends from is dropped, and tokens that all of them share are emitted."""
        arcs, starts = self.vocabulary.arcs, list(iter_unpack(_START, self._states[state]))
        nodes, origin, made = [], FREE, FREE
        for node, _, before in starts:
            if node >= 0:
                node, token = arcs[node].get(byte, _NOWHERE)
                if token >= 0 and origin < 0 and self._stays(before, token):
                    origin, made = len(nodes), token
                if node >= 0 and not self._open(before, node):
                    node = FREE
            nodes.append(node)
        if origin < 0:
            raise ValueError("the vocabulary lacks a single byte")
        branches = [0] * len(nodes)
        branches[origin] = 1
        for i in range(len(nodes) - 1, 0, -1):
            if nodes[i] >= 0 or branches[i]:
                branches[starts[i][1]] += 1
        root, emitted, end = 0, (), len(nodes)
        while root < end and nodes[root] < 0 and branches[root] == 1:
            root = self._only_branch(starts, nodes, branches, root)
            emitted += (starts[root][2] if root < end else made,)
        if root == end:
            kept = [(0, FREE, made)]
        else:
            before = starts[root][2] if nodes[root] >= 0 else FREE
            place, kept = [0] * end, [(nodes[root], FREE, before)]
            for i in range(root + 1, end):
                if nodes[i] >= 0 or branches[i]:
                    place[i] = len(kept)
                    kept.append((nodes[i], place[starts[i][1]], starts[i][2]))
            kept.append((0, place[origin], made))
        key = b"".join(pack(_START, *start) for start in kept)
        number = self._number.get(key)
        if number is None:
            number = self._number[key] = len(self._states)
            self._states.append(key)
            self._ends.append(None)
        if not emitted:
            return number
        self._emitting.append((number, emitted))
        return -len(self._emitting)

    @staticmethod
    def _only_branch(starts, nodes, branches, root: int) -> int:
        for i in range(root + 1, len(nodes)):
            if starts[i][1] == root and (nodes[i] >= 0 or branches[i]):
                return i
        return len(nodes)

    def _end(self, state: int) -> tuple[int, ...]:
        starts = list(iter_unpack(_START, self._states[state]))
        at, tail = len(starts) - 1, []
        while starts[at][1] != FREE:
            tail.append(starts[at][2])
            at = starts[at][1]
        return tuple(reversed(tail))

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one piece. A piece that is itself a token is that token."""
        whole = self.vocabulary.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self._states) > self.max_states:
            self._forget()
        arcs, state, ids = self._arcs, 0, []
        for byte in piece:
            step = arcs.get(state << 8 | byte)
            if step is None:
                step = arcs[state << 8 | byte] = self._arc(state, byte)
            if step >= 0:
                state = step
            else:
                state, emitted = self._emitting[-step - 1]
                ids += emitted
        end = self._ends[state]
        if end is None:
            end = self._ends[state] = self._end(state)
        ids += end
        return ids


class TextEncoder:
    """Encodes whole texts: cuts them by the pattern and sends pieces through the
    transducer. Words met before are kept, at most ``max_words``: when half as many are new,
    those not met since the last time are forgotten."""

    def __init__(
        self, vocabulary: Vocabulary, pattern: str, max_words: int = MAX_WORDS, max_states: int = MAX_STATES
    ):
        self.transducer = Transducer(vocabulary, max_states)
        self.tokens = vocabulary.tokens
        self.pattern = regex.compile(pattern)
        self.max_words = max_words
        self._words: dict[str, bytes | None] = {}
        self._older: dict[str, bytes | None] = {}

    def pieces(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers, cut by the pattern directly."""
        encode, ids = self.transducer.encode, array("I")
        for piece in self.pattern.finditer(text):
            ids.extend(encode(piece[0].encode()))
        return ids.tobytes()

    def _word(self, word: str) -> bytes | None:
        """Ids of a blank and the word, or of a line end and the word after it. None where
        white space runs on, so that the pattern must see the whole text."""
        if word[:1] == "\n":
            rest = word[1:]
            return None if rest[:1].isspace() or not rest else self.pieces(word)
        if word.isalpha():
            return array("I", self.transducer.encode(f" {word}".encode())).tobytes()
        stem, last = word[:-1], word[-1:]
        if stem.isalpha() and last in ".,;:!?":
            return (self._words.get(stem) or self._word(stem)) + self.pieces(last)
        return None if word[:1].isspace() or not word else self.pieces(f" {word}")

    def encode(self, text: str) -> bytes:
        """A blank or line end before a visible character always begins a piece, so a text
        falls apart there; a text with other runs of white space is cut whole."""
        head, *words = text.replace("\n", " \n").split(" ")
        known = self._words
        if missing := set(words).difference(known):
            if 2 * (len(known) + len(missing)) > self.max_words:
                self._older, self._words = known, {}
                known, missing = self._words, set(words)
            older = self._older
            for word in missing:
                known[word] = older[word] if word in older else self._word(word)
        found = list(map(known.__getitem__, words))
        if None in found:
            return self.pieces(text)
        return self.pieces(head) + b"".join(found)


#: For each state of a UTF-8 reader, the bytes it takes and the state after.
_UTF8 = {
    0: [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5)]
    + [(0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)],
    1: [(0x80, 0xBF, 0)],
    2: [(0x80, 0xBF, 1)],
    3: [(0x80, 0xBF, 2)],
    4: [(0xA0, 0xBF, 1)],
    5: [(0x80, 0x9F, 1)],
    6: [(0x90, 0xBF, 2)],
    7: [(0x80, 0x8F, 2)],
}


class StreamingDecoder:
    """Turns ids into text piece by piece; a character cut by the end of a piece waits."""

    def __init__(self, tokens: dict[int, bytes]):
        self._token = tokens
        self._waiting = b""

    @staticmethod
    def _state(data: bytes) -> int:
        state = 0
        for byte in data:
            state = next((to for low, high, to in _UTF8[state] if low <= byte <= high), -1)
            if state < 0:
                raise ValueError("the ids are no UTF-8 text")
        return state

    def feed(self, ids: list[int]) -> bytes:
        """The bytes of all characters that are complete by now."""
        data = self._waiting + b"".join(map(self._token.__getitem__, ids))
        cut = len(data)
        while cut and len(data) - cut < 4 and data[cut - 1] & 0xC0 == 0x80:
            cut -= 1
        if cut and data[cut - 1] >= 0xC0:
            cut -= 1
        if self._state(data[cut:]) == 0:
            cut = len(data)
        self._waiting = data[cut:]
        data[:cut].decode()  # raises where the ids before are no text
        return data[:cut]

    def finish(self) -> None:
        if self._waiting:
            raise ValueError("the ids end inside a character")
