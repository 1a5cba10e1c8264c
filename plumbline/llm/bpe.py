"""BPE encoding and decoding with a tokenization automaton.

The automaton reads tokens.  It starts with one state in which every base symbol loops, and each merge, in order of
rank, adds one gadget: after the left part the right part may no longer be read, and wherever the left part could be
read the merged token now can, leading to a copy of the state where the right part led.  What the automaton accepts
are exactly the token sequences that the merges produce, and each text has one of them.  Every token leads to one
state whatever came before, so states are named by tokens, and a state is kept as the arcs its gadgets took away.

Encoding reads a word's symbols through an automaton of the tokens' spellings, and takes at each place the token
ending there for which the state at its start has an arc.  Each prefix of a word is reached by one arc, and the arcs
read backwards are the ids.  Decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Callable, Sequence
from functools import cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.llm.rows import annotate, held

WORD_END = "</w>"
#: Words and runs whose ids a task keeps at hand, in each of two generations, and transitions it keeps.
WORDS_HELD = 150_000
RUNS_HELD = 40_000
ARCS_HELD = 1_000_000
#: Bits of a token or symbol in a table's key.
_SHIFT = 24


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


#: From this letter on, versions of Unicode differ in what is a letter or a digit.
LATE = "\u0558"
#: Letters and digits that Unicode 16 added to the tables of this Python (15.1).
NEW_LETTERS = (
    "\\u1c89-\\u1c8a\\ua7cb-\\ua7cd\\ua7da-\\ua7dc\\U000105c0-\\U000105f3\\U00010d4a-\\U00010d65\\U00010d6f-\\U00010d85"
    "\\U00010ec2-\\U00010ec4\\U00011380-\\U00011389\\U0001138b\\U0001138e\\U00011390-\\U000113b5\\U000113b7\\U000113d1"
    "\\U000113d3\\U00011bc0-\\U00011be0\\U00013460-\\U000143fa\\U00016100-\\U0001611d\\U00016d40-\\U00016d6c\\U00018cff"
    "\\U0001e5d0-\\U0001e5ed\\U0001e5f0"
)
NEW_DIGITS = (
    "\\U00010d40-\\U00010d49\\U000116d0-\\U000116e3\\U00011bf0-\\U00011bf9\\U00016130-\\U00016139\\U00016d70-\\U00016d79"
    "\\U0001ccf0-\\U0001ccf9\\U0001e5f1-\\U0001e5fa"
)
#: White space to this Python, but not to the pattern.
NOT_SPACE = re.compile("[\x1c-\x1f]")
#: Capitals newer than this Python's tables: first, last, first small letter.
NEW_CAPITALS = [
    (0x1C89, 0x1C89, 0x1C8A),
    (0xA7CB, 0xA7CB, 0x0264),
    (0xA7CC, 0xA7CC, 0xA7CD),
    (0xA7CE, 0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2, 0xA7D3),
    (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB),
    (0xA7DC, 0xA7DC, 0x019B),
    (0x10D50, 0x10D65, 0x10D70),
    (0x16EA0, 0x16EB8, 0x16EBB),
]
_SMALL = {c: low + c - first for first, last, low in NEW_CAPITALS for c in range(first, last + 1)} | {ord("Σ"): "σ"}


def normalize(text: str) -> str:
    """NFC, then lower case character by character (no final sigma)."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return (text if max(text) < "Σ" else text.translate(_SMALL)).lower()


@cache
def ranges(category: str) -> str:
    """The characters of a general category in this Python's tables, as ranges of a pattern's set."""
    member = [unicodedata.category(chr(c))[0] == category for c in range(sys.maxunicode + 1)]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], np.array(member, dtype=np.int8), [0]]))).reshape(-1, 2)
    known = "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.tolist())
    return known + {"L": NEW_LETTERS, "N": NEW_DIGITS}[category]


class Automaton:
    """Tokens are numbers; ``merges`` are (left, right, merged) by rank; ``spelling`` gives a token's base symbols.

    State -1 is the start, where every token can be read; state t is where token t leads.
    """

    def __init__(self, merges: Sequence[tuple[int, int, int]], spelling: dict[int, tuple[int, ...]]):
        #: Arcs taken away: (token that led to the state, token of the arc) -> rank of the gadget.
        self.taken: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        tokens = {t for t, s in spelling.items() if len(s) == 1}
        for rank, (left, right, merged) in enumerate(merges):
            if left in tokens and right in tokens and merged not in tokens and self.has_arc(left, right):
                self.parts[merged] = left, right, rank
                self.taken[left, right] = rank
                tokens.add(merged)
        #: The table of transitions, filled as it is used: state and token -> whether there is an arc.
        self.table: dict[int, bool] = {}
        #: Transitions of the symbols' automaton: node and symbol -> node.  A node is the longest end of what was read
        #: that begins a token; ``ending`` lists the tokens that end there with their lengths, longest first.
        self.nodes: dict[int, int] = {}
        at_node = [-1]
        children: list[list[tuple[int, int]]] = [[]]
        for token in tokens:
            node = 0
            for symbol in spelling[token]:
                key = node << _SHIFT | symbol
                below = self.nodes.get(key, -1)
                if below < 0:
                    below = self.nodes[key] = len(at_node)
                    children[node].append((symbol, below))
                    children.append([])
                    at_node.append(-1)
                node = below
            at_node[node] = token
        self.shorter = [0] * len(at_node)
        self.ending: list[tuple[tuple[int, int], ...]] = [()] * len(at_node)
        self.followed: dict[int, int] = {}
        level, length = [0], 0
        while level:
            length += 1
            below_level = []
            for node in level:
                for symbol, below in children[node]:
                    back = self.shorter[below] = self._follow(self.shorter[node], symbol) if node else 0
                    own = ((at_node[below], length),) if at_node[below] >= 0 else ()
                    self.ending[below] = own + self.ending[back]
                    below_level.append(below)
            level = below_level
        self.followed.clear()
        #: Of each node what a transition to it gives: the node as the first part of a key, and the tokens ending there.
        self.reached = [(node << _SHIFT, ending) for node, ending in enumerate(self.ending)]
        #: Transitions as they are used: node and symbol -> what is reached.
        self.moves: dict[int, tuple[int, tuple[tuple[int, int], ...]]] = {}

    def _move(self, key: int) -> tuple[int, tuple[tuple[int, int], ...]]:
        """What the transition ``key`` reaches; kept for the next time."""
        after = self.nodes.get(key)
        if after is None:
            after = self._follow(key >> _SHIFT, key & (1 << _SHIFT) - 1)
        if len(self.moves) >= ARCS_HELD:
            self.moves.clear()
        found = self.moves[key] = self.reached[after]
        return found

    def _follow(self, node: int, symbol: int) -> int:
        """The transition from any node, through ever shorter ends; kept for the next time."""
        first = node
        while True:
            found = self.nodes.get(node << _SHIFT | symbol, -1)
            if found >= 0 or not node:
                break
            node = self.shorter[node]
        if len(self.followed) >= ARCS_HELD:
            self.followed.clear()
        found = self.followed[first << _SHIFT | symbol] = max(found, 0)
        return found

    def has_arc(self, state: int, token: int) -> bool:
        """Whether ``token`` can be read in ``state``.

        The state of a merged token is a copy of its right part's, so it lacks what gadgets of lower rank took from
        that; and a merged token was added only where its left part could still be read, after the same gadget took
        its arc away.
        """
        copied = len(self.parts) + len(self.taken) + (1 << 40)
        while True:
            arc, added = token, 1 << 40
            while True:
                rank = self.taken.get((state, arc))
                if rank is not None and rank < copied and rank <= added:
                    return False
                if arc not in self.parts:
                    break
                arc, _, added = self.parts[arc]
            if state not in self.parts:
                return True
            _, state, copied = self.parts[state]

    def encode(self, symbols: Sequence[int]) -> list[int]:
        """The arcs of the only path that spells ``symbols``.

        Each prefix is spelt by one path, so a place is reached by one arc, whose token is the state there.
        """
        move, allows = self.moves.get, self.table.get
        # Of each place its arc, the arc as the first part of a key, and where the arc starts.
        arc, state, start = [-1], [-1], [0]
        base = end = 0
        for symbol in symbols:
            end += 1
            base, tokens = move(base | symbol) or self._move(base | symbol)
            for token, length in tokens:
                at = end - length
                if at:
                    allowed = allows(state[at] | token)
                    if allowed is None:
                        allowed = self._allow(arc[at], token)
                    if not allowed:
                        continue
                arc.append(token)
                state.append(token << _SHIFT)
                start.append(at)
                break
            else:
                raise ValueError("a symbol is no token")
        ids = []
        at = end
        while at:
            ids.append(arc[at])
            at = start[at]
        ids.reverse()
        return ids

    def _allow(self, state: int, token: int) -> bool:
        """Whether ``token`` can be read in ``state``; kept for the next time."""
        if len(self.table) >= ARCS_HELD:
            self.table.clear()
        found = self.table[state << _SHIFT | token] = self.has_arc(state, token)
        return found


class WordTokenizer:
    """A tokenizer file whose words end in ``</w>``: its splits, its automaton and its arc labels."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != WORD_END or data["decoder"] is not None:
            raise ValueError("a BPE file with word ends and no decoder is expected")
        kinds = [n["type"] for n in data["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("the normalizer NFC, white space, lower case is expected")
        self.labels = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.labels |= {i: t for t, i in self.special.items()}
        self.symbols = byte_symbols()
        vocab = model["vocab"]
        base = {vocab[s + end]: (vocab[s + end],) for s in self.symbols for end in ("", WORD_END)}
        spelling = dict(base)
        merges = []
        for left, right in model["merges"]:
            triple = vocab[left], vocab[right], vocab[left + right]
            spelling[triple[2]] = spelling[triple[0]] + spelling[triple[1]]
            merges.append(triple)
        self.automaton = Automaton(merges, spelling)
        self.inner = [vocab[s] for s in self.symbols]
        self.final = [vocab[s + WORD_END] for s in self.symbols]
        split = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        #: Splits by properties alone up to here; letters and digits are the same in every version of Unicode.
        self.plain = regex.compile(split)
        for name in ("L", "N"):
            split = split.replace(rf"\p{{{name}}}", ranges(name))
        self.split = regex.compile(split.replace("[[", "[").replace("]]", "]"))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        #: Ids, as bytes, of the pre-split words and of the runs between white space seen so far.
        self.known = _Held(self._word, WORDS_HELD)
        self.packed = _Held(self._run, RUNS_HELD)

    def words_of(self, text: str) -> list[str]:
        """The pre-split words of a normalised text."""
        return (self.plain if max(text, default="") < LATE else self.split).findall(text)

    def _word(self, word: str) -> bytes:
        octets = word.encode()
        symbols = list(map(self.inner.__getitem__, octets))
        symbols[-1] = self.final[octets[-1]]
        ids = self.automaton.encode(symbols)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _run(self, run: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.words_of(run)))

    def encode(self, text: str) -> np.ndarray:
        """Token ids as unsigned 32-bit little-endian numbers."""
        parts: list[bytes] = []
        for piece in self.cut.split(text) if self.cut else [text]:
            if piece in self.special:
                parts.append(self.special[piece].to_bytes(4, "little"))
            else:
                piece = normalize(piece)
                table = self.packed
                parts += [table[w] for w in (piece.split() if not NOT_SPACE.search(piece) else self.words_of(piece))]
        return np.frombuffer(b"".join(parts), dtype="<u4")

    def decode(self, ids: Sequence[int]) -> str:
        """The labels of the arcs, joined as the file's library does without a decoder; unknown ids are left out."""
        labels = self.labels
        try:
            return " ".join([labels[i] for i in ids])
        except KeyError:
            return " ".join([labels[i] for i in ids if i in labels])


class _Held(dict):
    """Values made once and kept in two generations of at most ``most`` keys, so that what is in use stays."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        self.make, self.most = make, most
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


def tokenizer(path: str) -> WordTokenizer:
    """One per Python worker: its tasks share the automaton and the words seen, until another operator runs on it."""
    return held(("bpe", path), lambda: WordTokenizer(path))


def encode(documents: DataFrame, path: str, *, text: str = "text", out: str = "ids") -> DataFrame:
    """Add array column ``out`` with the token ids of the whole text; null and empty texts have none.

    ``path`` must be readable on every executor.  Other columns stay; one named like ``out`` is replaced.
    """

    def make() -> Callable:
        coder = tokenizer(path)
        return lambda column: [[coder.encode(t).tolist() if t else [] for t in column.to_pylist()]]

    fields = T.StructType([T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])
    return annotate(documents, [text], make, fields)


def decode(encoded: DataFrame, path: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add string column ``out``: the labels of ``ids``; null and empty lists give the empty string."""

    def make() -> Callable:
        coder = tokenizer(path)
        return lambda column: [[coder.decode(x) if x else "" for x in column.to_pylist()]]

    return annotate(encoded, [ids], make, T.StructType([T.StructField(out, T.StringType(), False)]))


def digests(documents: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode each text and keep counts and digests only, so that no ids leave the task."""
    def make() -> Callable:
        coder = tokenizer(path)

        def one(text: str | None) -> tuple[int, str, str]:
            ids = coder.encode(text or "")
            decoded = coder.decode(ids.tolist()).encode()
            return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()

        return lambda column: list(zip(*map(one, column.to_pylist()), strict=True)) if len(column) else [[], [], []]

    fields = T.StructType(
        [
            T.StructField("n_tokens", T.LongType(), False),
            T.StructField("ids_sha256", T.StringType(), False),
            T.StructField("decoded_sha256", T.StringType(), False),
        ]
    )
    return annotate(documents, [text], make, fields, keep=[doc_id])
