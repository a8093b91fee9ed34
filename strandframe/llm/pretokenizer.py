"""Pre-tokenisation and pair merging of a byte-level BPE vocabulary, on arrays.

The text of a whole batch is one array of code points.  A class table turns it
into symbols (which look one or two characters ahead), and a finite automaton
over the symbols says before which characters a piece begins.  The automaton is
run as a scan: each symbol is a function from state to state, functions compose
associatively, so blocks are composed side by side and the block entries follow
from the composed functions.  No regular expression is used.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import unicodedata
from functools import cached_property

import numpy as np

#: Code points with the White_Space property.
WHITE_SPACE = (0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

LETTER, NUMBER, OTHER, SPACE, BLANK = range(5)
#: Symbols: a letter, a number, another character, an apostrophe that may open a
#: contraction of one or two letters, a space that joins the next piece, a
#: single blank that stands alone, a blank inside a run.
S_LETTER, S_NUMBER, S_OTHER, S_ONE, S_TWO, S_JOIN, S_LONE, S_RUN = range(8)
#: Added to the symbol of the first character of a text.
FIRST = 8
#: States after a character: in a letter, number or other piece, after a joining
#: space, after a lone blank, in a blank run, with one or two contraction
#: letters to come, after a contraction.
IN_LETTER, IN_NUMBER, IN_OTHER, JOINING, AFTER_LONE, IN_RUN, ONE_MORE, TWO_MORE, DONE = range(9)
STATES = 9
BLOCK = 64
#: A worker remembers at most so many pieces.
CACHE_PIECES = 1 << 18


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """State after a symbol, and whether a piece begins before it, by (symbol, state)."""
    move = np.zeros((16, STATES), dtype=np.uint8)
    begins = np.zeros((16, STATES), dtype=bool)
    for state in range(STATES):
        for symbol, inside in ((S_LETTER, IN_LETTER), (S_NUMBER, IN_NUMBER), (S_OTHER, IN_OTHER)):
            move[symbol, state], begins[symbol, state] = inside, state not in (inside, JOINING)
        if state in (ONE_MORE, TWO_MORE):
            move[S_LETTER, state], begins[S_LETTER, state] = (DONE if state == ONE_MORE else ONE_MORE), False
        for symbol, opened in ((S_ONE, ONE_MORE), (S_TWO, TWO_MORE)):
            joins = state in (IN_OTHER, JOINING)
            move[symbol, state], begins[symbol, state] = (IN_OTHER if joins else opened), not joins
        move[S_JOIN, state], begins[S_JOIN, state] = JOINING, True
        move[S_LONE, state], begins[S_LONE, state] = AFTER_LONE, True
        move[S_RUN, state], begins[S_RUN, state] = IN_RUN, state != IN_RUN
    for symbol in range(FIRST):
        move[symbol + FIRST, :], begins[symbol + FIRST, :] = move[symbol, DONE], True
    return move, begins


MOVE, BEGINS = _tables()
_classes: np.ndarray | None = None


def code_point_classes() -> np.ndarray:
    """Class of every code point, built once per process from Unicode categories."""
    global _classes
    if _classes is None:
        table = np.full(0x110000, OTHER, dtype=np.uint8)
        kinds = {"L": LETTER, "N": NUMBER}
        for code in range(0x110000):
            kind = kinds.get(unicodedata.category(chr(code))[0])
            if kind is not None:
                table[code] = kind
        table[list(WHITE_SPACE)] = BLANK
        table[0x20] = SPACE
        _classes = table
    return _classes


def _symbols(codes: np.ndarray, last: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbols of the characters; ``last`` and ``first`` mark ends and starts of texts."""
    kind = code_point_classes()[codes]
    n = len(codes)
    after = np.concatenate([codes[1:], [0]]).astype(np.uint32)
    after[last] = 0
    third = np.concatenate([after[1:], [0]]).astype(np.uint32)
    third[last] = 0
    symbol = kind.copy()
    blank = kind >= SPACE
    blank_next = np.zeros(n, dtype=bool)
    blank_next[:-1] = blank[1:]
    blank_next[last] = True  # a run at the end of a text is one piece
    symbol[blank] = S_RUN
    ends = blank & ~blank_next
    symbol[ends] = np.where(kind[ends] == SPACE, S_JOIN, S_LONE)
    quote = np.flatnonzero(codes == ord("'"))
    a, b = after[quote], third[quote]
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ((a == ord("l")) & (b == ord("l"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("r")) & (b == ord("e")))
    symbol[quote[one]] = S_ONE
    symbol[quote[two]] = S_TWO
    symbol[first] += FIRST
    return symbol


def scan_states(symbols: np.ndarray) -> np.ndarray:
    """State before each character, by composing transition functions in blocks."""
    n = len(symbols)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, S_LETTER, dtype=np.uint8)
    padded[:n] = symbols
    grid = padded.reshape(blocks, BLOCK)
    whole = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (blocks, STATES))
    for j in range(BLOCK):
        whole = np.take_along_axis(MOVE[grid[:, j]], whole.astype(np.intp), axis=1)
    # functions of all blocks up to and including each block, by doubling
    upto, step = whole, 1
    while step < blocks:
        later = np.take_along_axis(upto[step:], upto[:-step].astype(np.intp), axis=1)
        upto = np.concatenate([upto[:step], later])
        step *= 2
    state = np.full(blocks, DONE, dtype=np.uint8)
    state[1:] = upto[:-1, DONE]
    before = np.empty((blocks, BLOCK), dtype=np.uint8)
    for j in range(BLOCK):
        before[:, j] = state
        state = MOVE[grid[:, j], state]
    return before.reshape(-1)[:n]


def piece_starts(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """UTF-8 of all texts, the byte offsets at which pieces begin, and the number
    of pieces of each text."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    joined = "".join(texts)
    if not joined:
        return b"", np.zeros(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    filled = lengths > 0
    ends = np.cumsum(lengths)[filled]
    first = ends - lengths[filled]
    symbols = _symbols(codes, ends - 1, first)
    begins = BEGINS[symbols, scan_states(symbols)]
    width = 1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000)
    at = np.cumsum(width, dtype=np.int64) - width
    counts = np.zeros(len(texts), dtype=np.int64)
    counts[filled] = np.add.reduceat(begins.astype(np.int64), first)
    return joined.encode("utf-8"), at[begins], counts


class ByteBpe:
    """Ids of byte-level BPE pieces by ranked pair merging, with a bounded cache."""

    def __init__(self, rank_file: str):
        with open(rank_file, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece: the adjacent pair of lowest rank is merged first, the
        leftmost among equals.  A heap over a linked list keeps long pieces at
        n log n."""
        if piece in self.ranks:
            return (self.ranks[piece],)
        n = len(piece)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        heap: list[tuple[int, int, bytes]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j >= 0:
                pair = part[i] + part[j]
                rank = self.ranks.get(pair)
                if rank is not None:
                    heapq.heappush(heap, (rank, i, pair))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = right[i] if part[i] is not None else -1
            if j < 0 or part[i] + part[j] != pair:
                continue
            part[i], part[j] = pair, None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return tuple(self.ranks[p] for p in part if p is not None)

    def _ids(self, piece: bytes) -> tuple[int, ...]:
        ids = self.cache.get(piece)
        if ids is None:
            ids = self.merge(piece)
            if len(self.cache) >= CACHE_PIECES:
                self.cache.clear()
            if len(piece) <= 64:
                self.cache[piece] = ids
        return ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has."""
        data, starts, counts = piece_starts(texts)
        bounds = [*starts.tolist(), len(data)]
        groups = [self._ids(data[a:b]) for a, b in itertools.pairwise(bounds)]
        sizes = np.fromiter(map(len, groups), dtype=np.int64, count=len(groups))
        ids = np.fromiter(itertools.chain.from_iterable(groups), dtype=np.int32, count=int(sizes.sum()))
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum(counts)
        return ids, upto[ends] - upto[ends - counts]

    def widths(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of each id; their running sum gives the offsets of a text."""
        return self.sizes[ids]

    @cached_property
    def sizes(self) -> np.ndarray:
        """Bytes of the token of each id, filled once."""
        size = np.zeros(max(self.tokens) + 1, dtype=np.int32)
        for rank, token in self.tokens.items():
            size[rank] = len(token)
        return size

    def decode(self, ids: list[int]) -> str:
        """Text of a list of ids."""
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")
