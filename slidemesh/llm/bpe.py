"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

Every prefix of a piece has one BPE encoding, so each position has one last token, and two tokens may follow each other exactly if their
joined bytes encode to the two. A state of the transducer therefore is, for every start position from which a vocabulary entry may still be
running, its trie node and the token that ends at that start. Reading a byte advances the running entries, closes the one that ends here
validly, and outputs it as the last token of this position. The ids up to a position are the chain of last tokens back from it; a token is
final once the chains of all running entries share it, and those start at most the longest entry back. States and steps are made when
first met and kept in a table of bounded size; when it is full, further steps are worked out each time."""

from __future__ import annotations

import base64
import codecs
import gc
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidemesh.llm.common import query, ship, table

MAX_STATES = 150_000    # beyond them steps are taken without being kept, results do not change
MAX_PAIRS = 300_000
MAX_WORDS, MAX_CUTS = 200_000, 60_000    # per generation of a table
SMALL = 4               # small tables: bounds are divided by it, that of the words by two
# Letters and numbers that Unicode added after version 16, hexadecimal ranges.
ADDED = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 "
    "10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff "
    "18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 "
    "1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 "
    "3d000-3fc3f "
)
NEWER = regex.compile("[" + "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in ADDED.split()) + "]")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""     # fixed value: the pattern that cutting at spaces relies on
OUT_BYTES = 8_000_000   # per output batch


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: base64 token and rank per line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def merge_ranks(data: bytes, ranks: dict[bytes, int], stop: int = 1) -> list[bytes]:
    """Plain merging of one short byte string, lowest rank first, leftmost on ties, until `stop` parts are left."""
    parts = [data[i:i + 1] for i in range(len(data))]
    while len(parts) > stop:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


_LAST = 20              # bits of a token number in packed states; states are tuples of trie node and last token + 1
_MASK = (1 << _LAST) - 1


class Transducer:
    def __init__(self, ranks: dict[bytes, int], small: bool = False):
        self.most_states, self.most_pairs = (x // (SMALL if small else 1) for x in (MAX_STATES, MAX_PAIRS))
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.length = {i: len(b) for b, i in ranks.items()}
        self.trie: dict[int, int] = {}      # node << 8 | byte -> node
        self.token_at, self.depth, self.inner = [-1], [0], [True]
        for data, rank in ranks.items():
            node = 0
            for byte in data:
                key = node << 8 | byte
                nxt = self.trie.get(key)
                if nxt is None:
                    nxt = self.trie[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.depth.append(self.depth[node] + 1)
                    self.inner.append(False)
                self.inner[node] = True
                node = nxt
            self.token_at[node] = rank
        self.spines: dict[tuple[int, int], tuple] = {}
        self.follows: dict[int, bool] = {}
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.steps: dict[int, int] = {}     # state << 8 | byte -> next state << _LAST | token
        self.start = self._state((0,))

    def _state(self, state: tuple) -> int:
        k = self.number.get(state)
        if k is None:
            k = self.number[state] = len(self.states)
            self.states.append(state)
        return k

    def spine(self, token: int, side: int) -> tuple:
        """(bytes, rank it was formed at, rank it is merged at) of the parts at the left (0) or right (1) edge of a token, outermost first."""
        got = self.spines.get((token, side))
        if got is None:
            data, out, until = self.bytes_of[token], [], 1 << 60
            while len(data) > 1:
                rank = self.ranks[data]
                out.append((data, rank, until))
                data, until = merge_ranks(data, self.ranks, stop=2)[side], rank
            out.append((data, -1, until))
            got = self.spines[token, side] = tuple(out)
        return got

    def may_follow(self, a: int, b: int) -> bool:
        """Whether b can come right after a: no part at a's right edge merges with one at b's left edge while both are there."""
        key = a << 32 | b
        known = self.follows.get(key)
        if known is None:
            known, get = True, self.ranks.get
            left = self.spine(b, 0)
            for p, made_p, until_p in self.spine(a, 1):
                for q, made_q, until_q in left:
                    rank = get(p + q)
                    if rank is not None and rank < until_p and rank <= until_q and made_p < until_q and made_q < until_p:
                        known = False
                        break
                if not known:
                    break
            if len(self.follows) >= self.most_pairs:
                self.follows.clear()
            self.follows[key] = known
        return known

    def advance(self, running: tuple, byte: int) -> tuple[tuple, int]:
        """(entries running after a byte, last token of the new position)."""
        nexts, closed = [], -1
        trie, token_at, inner, follows = self.trie, self.token_at, self.inner, self.follows
        for entry in running:
            nxt = trie.get(entry >> _LAST << 8 | byte)
            if nxt is None:
                continue
            last = entry & _MASK
            if closed < 0:
                token = token_at[nxt]
                if token >= 0:
                    if not last:
                        closed = token
                    else:
                        fits = follows.get(last - 1 << 32 | token)
                        if self.may_follow(last - 1, token) if fits is None else fits:
                            closed = token
            if inner[nxt]:
                nexts.append(nxt << _LAST | last)
        if closed < 0:
            raise ValueError("the vocabulary cannot encode every byte")
        nexts.append(closed + 1)
        return tuple(nexts), closed

    def last_tokens(self, data: Iterable[int]) -> Iterator[tuple[tuple, int]]:
        """(entries running, last token) after each byte."""
        k, running, steps = self.start, None, self.steps
        for byte in data:
            if running is None:
                got = steps.get(k << 8 | byte)
                if got is None:
                    new, closed = self.advance(self.states[k], byte)
                    if new in self.number or len(self.states) < self.most_states:
                        got = steps[k << 8 | byte] = self._state(new) << _LAST | closed
                    else:
                        running = new
                        yield running, closed
                        continue
                k = got >> _LAST
                yield self.states[k], got & _MASK
            else:
                running, closed = self.advance(running, byte)
                yield running, closed

    def run(self, data: Iterable[int], check: int = 4096) -> Iterator[int]:
        """Tokens of a byte stream; every `check` bytes those that no continuation can change are given out."""
        ends: list[int] = []
        for running, token in self.last_tokens(data):
            ends.append(token)
            if len(ends) >= check:
                chains = [self._chain(ends, len(ends) - self.depth[entry >> _LAST]) for entry in running]
                shared, least = 0, min(map(len, chains))
                while shared < least and len({c[shared] for c in chains}) == 1:
                    shared += 1
                yield from chains[0][:shared]
                del ends[:sum(self.length[t] for t in chains[0][:shared])]
        yield from self._chain(ends, len(ends))

    def _chain(self, ends: list[int], at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(ends[at - 1])
            at -= self.length[out[-1]]
        return out[::-1]

    def piece(self, data: bytes) -> tuple[int, ...]:
        """Ids of one piece; a piece that is an entry itself is that entry."""
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        if len(data) > 4096:
            return tuple(self.run(data))
        k, ends, steps, at = self.start, [], self.steps, 0
        for byte in data:       # last_tokens in line: this is the inner loop
            got = steps.get(k << 8 | byte)
            if got is None:
                new, closed = self.advance(self.states[k], byte)
                if len(self.states) >= self.most_states and new not in self.number:
                    ends.append(closed)
                    at = len(ends)
                    break
                got = steps[k << 8 | byte] = self._state(new) << _LAST | closed
            k = got >> _LAST
            ends.append(got & _MASK)
        if at:
            running = new
            for byte in data[at:]:
                running, closed = self.advance(running, byte)
                ends.append(closed)
        return tuple(self._chain(ends, len(ends)))


class Irregular(Exception):
    """A cut of a text that cannot be split by itself."""


class Generations(dict):
    """A bounded table filled by `make`: when it is full it becomes the old half, and entries still in use move on to the new one."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Splits text by the pattern and encodes each match; ids are kept as little-endian 32-bit integers.

    A space between two characters that are not white space always begins a match, so text is cut there first and the ids of a cut (with its
    space) are looked up whole. A cut of letters, with or without a comma or the like behind, needs no pattern. A text with other white space
    around a space is split by the pattern as it stands. Tables are bounded, with `small` to about a third of the memory."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, small: bool = False):
        self.transducer = Transducer(ranks, small)
        self.pattern = regex.compile(pattern)
        self.words = Generations(lambda p: np.array(self.transducer.piece(p.encode("utf-8")), "<u4").tobytes(), MAX_WORDS // (2 if small else 1))
        self.cuts = Generations(self._cut, MAX_CUTS // (SMALL if small else 1))
        self.plain = pattern == PATTERN

    def _matches(self, text: str) -> Iterator[str]:
        """Matches of the pattern, with letters and numbers as of Unicode 16: what the pattern module knows beyond that counts as other."""
        if text.isascii() or not NEWER.search(text):
            return (m[0] for m in self.pattern.finditer(text))
        return (text[m.start():m.end()] for m in self.pattern.finditer(NEWER.sub("\ue000", text)))

    def _split(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self._matches(text)))

    def _cut(self, cut: str) -> bytes:
        if not cut or cut[0].isspace() or cut[-1].isspace():
            raise Irregular
        if cut.isalpha() and (cut.isascii() or not NEWER.search(cut)):
            return self.words[" " + cut]
        if cut[-1] in ".,;:!?" and (word := cut[:-1]).isalpha() and (word.isascii() or not NEWER.search(word)):
            return self.words[" " + word] + self.words[cut[-1]]
        return self._split(" " + cut)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        cuts = text.split(" ") if self.plain else [text]
        if len(cuts) == 1 or not cuts[0] or cuts[0][-1].isspace():
            return self._split(text)
        try:
            rest = b"".join(map(self.cuts.__getitem__, cuts[1:]))
        except Irregular:
            return self._split(text)
        return self._split(cuts[0]) + rest


class StreamDecoder:
    """Bytes and text of an id stream fed in parts; characters that span tokens or parts are completed by the incremental UTF-8 state."""

    def __init__(self, bytes_of: dict[int, bytes], errors: str = "replace"):
        self.bytes_of = bytes_of
        self.utf8 = codecs.getincrementaldecoder("utf-8")(errors)

    def feed(self, ids: Iterable[int], final: bool = False) -> str:
        return self.utf8.decode(b"".join(map(self.bytes_of.__getitem__, ids)), final)


_MADE: dict[tuple, Encoder] = {}


def _encoder(shared, pattern: str) -> Encoder:
    """One encoder per Python worker, whose trie serves all tasks."""
    key = (hash(shared.value), pattern)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Encoder(read_ranks(shared.value), pattern)
    return _MADE[key]


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], weigh) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weigh(row)
        if size >= OUT_BYTES or len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


def _share(spark, ranks_path: str):
    with open(ranks_path, "rb") as f:       # a vocabulary of fixed size, sent to the executors by the driver
        return spark.sparkContext.broadcast(f.read())


def _rows(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[tuple]:
    """Rows of Arrow batches, a few converted at a time."""
    for b in batches:
        for at in range(0, b.num_rows, step):
            yield from zip(*(c.to_pylist() for c in b.slice(at, step).columns))


def _pass(docs: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str, back: bool, keep: bool) -> DataFrame:
    ship(docs.sparkSession)
    shared = _share(docs.sparkSession, ranks_path)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = ["id", "n_tokens", "ids"] + ["decoded"] * back

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        enc = _encoder(shared, pattern) if keep else Encoder(read_ranks(shared.value), pattern, True)
        gc.freeze()         # the tables hold no cycles: keep the collector from walking them again and again
        kinds = [first.schema.field(0).type, pa.int64(), pa.binary(), pa.string()][:len(names)]

        def rows() -> Iterator[tuple]:
            for i, text in _rows(chain([first], batches)):
                ids = enc.encode(text or "")
                yield (i, len(ids) // 4, ids, decode(enc.transducer.bytes_of, ids)) if back else (i, len(ids) // 4, ids)
        try:
            yield from _batches(rows(), names, kinds, lambda r: 2 * len(r[2]))
        finally:
            gc.unfreeze()
            if not keep:    # as a whole: a few objects made between those of the tables would hold most of their memory
                del enc, first
                gc.collect()
                pa.default_memory_pool().release_unused()

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, n_tokens long, ids binary" + ", decoded string" * back)


def decode(bytes_of: dict[int, bytes], ids: bytes, step: int = 4096) -> str:
    """Text of little-endian 32-bit ids, fed to the streaming decoder `step` at a time."""
    numbers, out = np.frombuffer(ids, "<u4"), StreamDecoder(bytes_of)
    parts = [out.feed(numbers[at:at + step].tolist()) for at in range(0, len(numbers), step)]
    return "".join(parts) + out.feed((), True)


def encoded(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """(id, n_tokens, ids) of every row, ids as little-endian unsigned 32-bit integers; whole texts, no special tokens.

    A null text counts as empty and has no ids. Rows are independent: ids may repeat or be null, other columns are not looked at, an empty
    table gives an empty result. With `keep` the bounded tables of a Python worker serve its next tasks too, which saves filling them again;
    without, a task has an encoder of its own with small tables, and leaves nothing of it behind, for jobs whose steps share a worker's memory."""
    return _pass(docs, ranks_path, pattern, id_col, text_col, False, keep)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """`encoded` and, from the ids, `decoded` text in one pass over the table."""
    return _pass(docs, ranks_path, pattern, id_col, text_col, True, keep)


def decoded(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """`tokens` (id, n_tokens, ids) with the column `decoded`. Ids that are not in the vocabulary raise; byte sequences that are not UTF-8 become
    replacement characters; null ids give an empty text."""
    shared = _share(tokens.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = _encoder_bytes(shared)
        first = next(batches, None)
        if first is not None:
            rows = ((i, n, data, decode(bytes_of, data or b"")) for i, n, data in _rows(chain([first], batches)))
            yield from _batches(rows, ["id", "n_tokens", "ids", "decoded"], [*(f.type for f in first.schema), pa.string()], lambda r: 2 * len(r[2] or b""))

    kind = tokens.schema["id"].dataType.simpleString()
    return tokens.select("id", "n_tokens", "ids").mapInArrow(run, f"id {kind}, n_tokens long, ids binary, decoded string")


_BYTES: dict[int, dict[int, bytes]] = {}


def _encoder_bytes(shared) -> dict[int, bytes]:
    key = hash(shared.value)
    if key not in _BYTES:
        _BYTES.clear()
        _BYTES[key] = {i: b for b, i in read_ranks(shared.value).items()}
    return _BYTES[key]


def vocabulary() -> tuple[str, str]:
    """Path and split pattern of the multilingual rank file."""
    import public_tokenizers as P
    return P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN


@query("op7_bpe_transducer")
def op7_bpe_transducer(spark, sf):
    """One row per document: number of tokens, digest of the ids, digest of the decoded bytes."""
    path, pattern = vocabulary()
    out = round_trip(table(spark, sf, "documents"), path, pattern)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
