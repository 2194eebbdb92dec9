"""Subword pieces with seeded merge-dropout, and their lossless decoding."""

from __future__ import annotations

import heapq
import random
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.oddsketch import mix
from geoloom.llm.store import ship_by_value, small_batches

ship_by_value(__name__)

MARK = "▁"
ALL = (1 << 64) - 1


@dataclass
class Merges:
    """All merges as arrays. Symbols are pieces and the signs that stand in them; ``pairs`` (left << 32 | right, sorted)
    become the symbols ``joined`` with the ranks ``order``. ``points`` are the code points of symbols that are ``signs``,
    and symbol ``i`` is spelled by the ids ``spelled[ends[i]:ends[i + 1]]``."""

    pairs: np.ndarray
    order: np.ndarray
    joined: np.ndarray
    points: np.ndarray
    signs: np.ndarray
    spelled: np.ndarray
    ends: np.ndarray


def merge_arrays(ids: dict[str, int], rank: dict[str, int], byte: list[int]) -> Merges:
    symbol = {x: i for i, x in enumerate(sorted({*ids, *(c for x in ids for c in x)}))}
    found = sorted(
        (symbol[x[:i]] << 32 | symbol[x[i:]], rank[x], symbol[x])
        for x in ids for i in range(1, len(x)) if x[:i] in symbol and x[i:] in symbol
    )
    pairs, order, joined = (np.array([f[k] for f in found], t) for k, t in enumerate((np.uint64, np.int32, np.int32)))
    single = sorted((ord(x), i) for x, i in symbol.items() if len(x) == 1)
    spelled = [[ids[x]] if x in ids else [byte[b] for b in x.encode("utf-8", "surrogatepass")] for x in symbol]
    return Merges(
        pairs, order, joined, np.array([s[0] for s in single], np.int64), np.array([s[1] for s in single], np.int32),
        np.array([i for x in spelled for i in x], np.int32), np.cumsum([0, *map(len, spelled)]),
    )


@dataclass
class Pieces:
    """The pieces of a merge-type model: ids and ranks (the best score is 0), byte ids, and the bytes of every id."""

    ids: dict[str, int]
    rank: dict[str, int]
    byte: list[int]
    raw: list[bytes]
    cut: str = field(default="")
    merges: Merges | None = None


def load_pieces(path: str) -> Pieces:
    """Read a model file with byte fallback on the driver; tasks get its pieces, not the path."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, score, byte, raw = {}, {}, [0] * 256, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            value = int(piece[3:-1], 16)
            byte[value] = i
            raw.append(bytes([value]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            raw.append(b"")
        else:
            ids[piece], score[piece] = i, model.get_score(i)
            raw.append(piece.replace(MARK, " ").encode())
    order = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
    rank = {x: order[s] for x, s in score.items()}
    return Pieces(ids, rank, byte, raw, cut_pattern(ids), merge_arrays(ids, rank, byte))


def cut_pattern(ids: dict[str, int]) -> str:
    """Chunks a text falls into, by the vocabulary alone.

    Where two neighbours are in no piece side by side, no merge ever joins them, so a text
    can be cut there without changing any merge: before a blank, at a line end, and between
    letters and other signs (but for the letters that some piece has beside such a sign).
    """
    if any(re.search(f"[^{MARK}]{MARK}", x) for x in ids):
        return r"(?s:.+)"
    sign = rf"[^\w{MARK}]"
    mixed = {c for x in ids for pair in re.findall(rf"(?=(\w{sign}|{sign}\w))", x) for c in pair if re.match(r"\w", c)}
    odd = "".join(sorted(re.escape(c) for c in mixed))
    line = not any("\n" in x and len(x) > 1 for x in ids)
    ends = MARK + (r"\n" if line else "")
    return rf"{MARK}*[^\W{odd}]+|{MARK}*(?:(?![{ends}])[\W{odd}])+|{MARK}+" + (r"|\n" if line else "")


def scramble(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & ALL
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & ALL
    return x ^ (x >> 31)


SHORT = 64  # longest chunk whose agenda is a row of an array
NEVER = 1 << 62


def keyed_words(key: str, n: int) -> list[int]:
    """The first ``n`` 32-bit words that a key stands for."""
    return array("I", random.Random(key).randbytes(4 * n)).tolist()


def merge_short(rank: dict[str, int], chunk: str, by_rank: list[int], by_place: list[int], limit: int) -> list[str]:
    """Pieces of one short chunk in the plainest form, which the arrays of :class:`Cutter` are held against:
    the agenda is the list of the ranks of its neighbours, searched for the least."""
    get, part, place = rank.get, list(chunk), list(range(len(chunk)))
    agenda = [get(chunk[i : i + 2], NEVER) for i in range(len(chunk) - 1)]
    while agenda and (r := min(agenda)) != NEVER:
        i = agenda.index(r)
        if by_rank[r] ^ by_place[place[i]] < limit:
            agenda[i] = NEVER
            continue
        joined = part[i] = part[i] + part.pop(i + 1)
        del agenda[i], place[i + 1]
        if i < len(agenda):
            agenda[i] = get(joined + part[i + 1], NEVER)
        if i:
            agenda[i - 1] = get(part[i - 1] + joined, NEVER)
    return part


def merge_long(rank: dict[str, int], chunk: str, by_rank: list[int], by_place: list[int], limit: int) -> list[str]:
    """The same pieces with a heap as agenda, for chunks of any length."""
    part: list = list(chunk)
    n = len(part)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    agenda = [(rank[two], i, two) for i in range(n - 1) if (two := chunk[i : i + 2]) in rank]
    heapq.heapify(agenda)
    while agenda:
        r, i, joined = heapq.heappop(agenda)
        left, j = part[i], after[i]
        if left is None or j < 0 or left + part[j] != joined or by_rank[r] ^ by_place[i] < limit:
            continue
        part[i], part[j] = joined, None
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            if (more := joined + part[k]) in rank:
                heapq.heappush(agenda, (rank[more], i, more))
        h = before[i]
        if h >= 0 and (more := part[h] + joined) in rank:
            heapq.heappush(agenda, (rank[more], h, more))
    return [x for x in part if x is not None]


class Drops:
    """Stands for the keyed words of one occurrence: of its candidate merges, in the order they come up, those numbered ``at`` are dropped."""

    def __init__(self, at: tuple[int, ...]):
        self.at, self.seen = at, 0

    def __getitem__(self, _: int) -> int:
        self.seen += 1
        return 0 if self.seen - 1 in self.at else 1


GOLDEN = 0x9E3779B97F4A7C15
FAR = 1 << 40


def waits(keys: np.ndarray, dropout: float) -> np.ndarray:
    """How many candidates are spared before the next drop: independent draws of probability ``dropout``, from keys."""
    if dropout <= 0:
        return np.full(len(keys), FAR)
    if dropout >= 1:
        return np.zeros(len(keys), np.int64)
    u = ((mix(keys) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
    return np.floor(np.log(u) / np.log1p(-dropout)).astype(np.int64)


OTHER = 1 << 28  # signs that stand in no piece
NONE = (1 << 31) - 1  # no symbol
NO = np.int32((1 << 31) - 1)  # the rank of no merge


class Keyed:
    """Stands for the keyed words of one occurrence: candidate ``first`` is dropped, and how many are spared until the next is drawn from ``key``."""

    def __init__(self, key: int, first: int, dropout: float):
        self.key, self.next, self.dropout, self.seen, self.drops = key, first, dropout, 0, 0

    def __getitem__(self, _: int) -> int:
        self.seen += 1
        if self.seen - 1 != self.next:
            return 1
        self.drops += 1
        self.next = self.seen + int(waits(np.array([self.key + self.drops * GOLDEN & ALL], np.uint64), self.dropout)[0])
        return 0


@dataclass
class Lists:
    """Lists of ids: list ``i`` is ``flat[starts[i]:starts[i] + counts[i]]``."""

    starts: np.ndarray
    counts: np.ndarray
    flat: np.ndarray

    def laid(self) -> np.ndarray:
        """All lists end to end."""
        ends = np.cumsum(self.counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts - (ends - self.counts), self.counts) + np.arange(total)]

    def followed_by(self, more: Lists) -> Lists:
        starts = np.concatenate([self.starts, len(self.flat) + more.starts])
        return Lists(starts, np.concatenate([self.counts, more.counts]), np.concatenate([self.flat, more.flat]))


class Cutter:
    """Cuts many chunks at once: a row of an array is the agenda of one chunk.

    In each round every row takes its candidate merge of least rank, from the left, and drops it or does
    it. A later merge beside a dropped one may propose the place anew. Rows without candidates leave.
    """

    def __init__(self, p: Pieces, dropout: float, rows: int = 1 << 14):
        self.p, self.m, self.dropout, self.rows = p, p.merges, dropout, rows
        self.symbol = np.full(0x110000, -1, np.int32)
        self.symbol[self.m.points] = self.m.signs
        self.bits = max(4, int(len(self.m.pairs)).bit_length() + 2)
        self.slot = np.full(1 << self.bits, -1, np.int32)
        open_ = np.arange(len(self.m.pairs), dtype=np.int32)
        at = self._hash(self.m.pairs)
        while len(open_):
            free = self.slot[at] < 0
            self.slot[at[free]] = open_[free]
            left = self.slot[at] != open_
            open_, at = open_[left], (at[left] + 1) & (len(self.slot) - 1)
        self.at_slot = np.where(self.slot >= 0, self.m.pairs[self.slot] if len(self.m.pairs) else 0, np.uint64(ALL))

    def _hash(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs * np.uint64(GOLDEN) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and symbol of what neighbours join to; rank ``NO`` where they don't."""
        pairs = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = self._hash(pairs)
        held = self.at_slot[at]
        more = np.flatnonzero((held != pairs) & (held != ALL))
        while len(more):
            at[more] = (at[more] + 1) & (len(self.slot) - 1)
            held[more] = now = self.at_slot[at[more]]
            more = more[(now != pairs[more]) & (now != ALL)]
        rank, symbol = np.full(len(pairs), NO, np.int32), np.zeros(len(pairs), np.int32)
        hit = np.flatnonzero(held == pairs)
        which = self.slot[at[hit]]
        rank[hit], symbol[hit] = self.m.order[which], self.m.joined[which]
        return rank, symbol

    def cut(self, chunks: list[str], first: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, Lists]:
        """How many candidates came up and the piece ids, of each chunk; its candidate ``first`` is the first to drop."""
        seen, starts, counts, flat, end = *(np.zeros(len(chunks), np.int64) for _ in range(3)), [], 0

        def keep(part: np.ndarray, found: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
            nonlocal end
            seen[part], counts[part], starts[part] = found, count, end + np.cumsum(count) - count
            flat.append(ids)
            end += len(ids)

        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        low = 0
        for high in (4, 8, 12, 16, 24, 32, 48, SHORT):
            some = np.flatnonzero((size > low) & (size <= high))
            for at in range(0, len(some), self.rows):
                part = some[at : at + self.rows]
                keep(part, *self._rows([chunks[i] for i in part.tolist()], size[part], high, first[part], keys[part]))
            low = high
        for i in np.flatnonzero(size > SHORT).tolist():
            drops = Keyed(int(keys[i]), int(first[i]), self.dropout)
            pieces = merge_long(self.p.rank, chunks[i], drops, bytes(len(chunks[i])), 1)
            out: list[int] = []
            for x in pieces:
                out += [self.p.ids[x]] if x in self.p.ids else [self.p.byte[b] for b in x.encode("utf-8", "surrogatepass")]
            keep(np.array([i]), np.array([drops.seen]), np.array([len(out)]), np.array(out, np.int32))
        return seen, Lists(starts, counts, np.concatenate([np.zeros(0, np.int32), *flat]))

    def _rows(self, chunks, size, width, first, keys):
        n = len(chunks)
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        signs = self.symbol[points]
        # signs in no piece are numbered beyond the symbols and never join
        signs = np.where(signs < 0, OTHER + points, signs)
        row = np.repeat(np.arange(n), size)
        col = np.arange(len(points)) - np.repeat(np.cumsum(size) - size, size)
        part = np.full((n, width + 1), NONE, np.int64)
        part[row, col] = signs
        agenda, joined = np.full((n, width + 1), NO, np.int32), np.zeros((n, width + 1), np.int32)
        inner = np.flatnonzero(row[1:] == row[:-1])
        agenda[row[inner], col[inner]], joined[row[inner], col[inner]] = self._find(signs[inner], signs[inner + 1])
        # the last column stands for both ends of a chunk
        after = np.tile(np.append(np.arange(1, width + 1), width), (n, 1))
        before = np.tile(np.append(width, np.arange(width)), (n, 1))
        after[np.arange(n), size - 1] = width
        seen, drops, drop_at = np.zeros(n, np.int64), np.zeros(n, np.uint64), first.copy()
        rows = np.arange(n)
        while len(rows):
            i = agenda[rows].argmin(1)
            going = agenda[rows, i] != NO
            rows, i = rows[going], i[going]
            gone = seen[rows] == drop_at[rows]
            seen[rows] += 1
            r, k = rows[gone], i[gone]
            if len(r):
                agenda[r, k] = NO
                drops[r] += np.uint64(1)
                drop_at[r] = seen[r] + waits(keys[r] + drops[r] * np.uint64(GOLDEN), self.dropout)
            r, k = rows[~gone], i[~gone]
            new, j = joined[r, k], after[r, k]
            part[r, k], part[r, j], agenda[r, j] = new, NONE, NO
            h, k2 = before[r, k], after[r, j]
            after[r, k], before[r, k2] = k2, k
            agenda[r, k], joined[r, k] = self._find(new, part[r, k2])
            agenda[r, h], joined[r, h] = self._find(part[r, h], new)
        return seen, *self._spell(part, n)

    def _spell(self, part: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        row, col = np.nonzero(part != NONE)
        symbols = part[row, col]
        spelled, starts = self.m.spelled, self.m.ends
        other = symbols >= OTHER
        if other.any():
            rare, which = np.unique(symbols[other], return_inverse=True)
            bytes_of = [[self.p.byte[b] for b in chr(c - OTHER).encode("utf-8", "surrogatepass")] for c in rare.tolist()]
            symbols = symbols.copy()
            symbols[other] = len(starts) - 1 + which
            spelled = np.concatenate([spelled, np.array([b for x in bytes_of for b in x], np.int32)])
            starts = np.concatenate([starts, starts[-1] + np.cumsum([len(x) for x in bytes_of])])
        each = Lists(starts[symbols], starts[symbols + 1] - starts[symbols], spelled)
        return np.bincount(row, weights=each.counts, minlength=n).astype(np.int64), each.laid()


class Memory:
    """What a chunk becomes when no merge is dropped: how many candidates come up, and the piece ids. It decides no draw.

    The empty chunk stands for the sign that marks blanks in pieces, spelled in bytes.
    """

    def __init__(self, cutter: Cutter, size: int = 500_000):
        self.cutter, self.size = cutter, size
        self.clear()

    def clear(self) -> None:
        mark = [self.cutter.p.byte[b] for b in MARK.encode()]
        self.at, self.seen = {"": 0}, np.zeros(1, np.int64)
        self.ids = Lists(np.zeros(1, np.int64), np.array([len(mark)]), np.array(mark, np.int32))

    def places(self, chunks: list[str]) -> np.ndarray:
        """Where each chunk is remembered; new ones are learnt."""
        if len(self.at) > self.size or len(self.ids.flat) > 8 * self.size:
            self.clear()
        new = list(set(chunks).difference(self.at))
        if new:
            seen, ids = self.cutter.cut(new, np.full(len(new), FAR), np.zeros(len(new), np.uint64))
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            self.seen, self.ids = np.concatenate([self.seen, seen]), self.ids.followed_by(ids)
        return np.fromiter(map(self.at.__getitem__, chunks), np.int64, len(chunks))


def chunks_of(text: str, find) -> list[str]:
    if MARK not in text:
        return find(MARK + text.replace(" ", MARK)) if text else []
    out: list[str] = []
    for i, x in enumerate((" " + text).split(MARK)):
        out += [""] * (i > 0) + find(x.replace(" ", MARK))
    return out


def encode_texts(texts: list[str], starts: list[int], memory: Memory, find) -> tuple[np.ndarray, np.ndarray]:
    """How many piece ids each text has, and all ids; each occurrence of a chunk draws anew, keyed by the text's start and its place."""
    parts = [chunks_of(t, find) for t in texts]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    chunks = list(chain.from_iterable(parts))
    at = memory.places(chunks)
    place = np.arange(1, len(chunks) + 1) - np.repeat(np.cumsum(size) - size, size)
    keys = mix(place.astype(np.uint64) * np.uint64(GOLDEN) + np.repeat(np.array(starts, np.uint64), size))
    first = waits(keys, memory.cutter.dropout)
    hit = np.flatnonzero(first < memory.seen[at])
    _, cut = memory.cutter.cut([chunks[i] for i in hit.tolist()], first[hit], keys[hit])
    plain = memory.ids
    ids = Lists(plain.starts[at], plain.counts[at], np.concatenate([plain.flat, cut.flat]))
    ids.starts[hit], ids.counts[hit] = len(plain.flat) + cut.starts, cut.counts
    before = np.cumsum(np.append(0, ids.counts))
    ends = np.cumsum(size)
    return before[ends] - before[ends - size], ids.laid()


def encode(docs: DataFrame, pieces: Pieces, seed: int = 1, dropout: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, ids)`` for every row of ``docs``.

    A merge is skipped with probability ``dropout`` by a hash keyed with the seed, the
    document and the place of its chunk, so a text
    has the same pieces in every run; another seed gives other ones, and each occurrence of a
    word draws anew. A task remembers what a word becomes without drops; all occurrences with drops in
    a batch are cut together. Without dropout the pieces are those of the model itself. Every
    text is encoded to its end; the sign that marks blanks in pieces is spelled in bytes where a text has it.
    Null texts have null ids, empty ones none; a null id counts as zero. Other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(Cutter(pieces, dropout))
        find = re.compile(pieces.cut).findall
        for b in batches:
            starts = [scramble((doc or 0) * GOLDEN + seed & ALL) for doc in b.column(0).to_pylist()]
            count, flat = encode_texts([t or "" for t in b.column(1).to_pylist()], starts, memory, find)
            ends = np.append(0, np.cumsum(count))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=b.column(1).is_null())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), ids], names=["doc_id", "text", "ids"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, text string, ids array<int>")


def decode_lists(raw: pa.Array, ids: pa.ListArray) -> list[str | None]:
    """The text of every list of ids: the bytes of all ids are laid end to end and cut where lists end."""
    spelled = raw.take(ids.values)
    _, ends, laid = spelled.buffers()
    if not len(spelled):
        ends, laid = bytes(8), b""
    data = memoryview(laid or b"")
    cuts = np.frombuffer(ends, np.int64)[ids.offsets.to_numpy()].tolist()
    known = ids.is_valid().to_pylist()
    return [str(data[a:z], "utf-8", "surrogatepass")[1:] if ok else None for a, z, ok in zip(cuts, cuts[1:], known, strict=False)]


def decode(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """``encoded`` with ``decoded``: the text that its ``ids`` spell. Null ids give null."""
    spelling = pieces.raw
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = pa.array(spelling, pa.large_binary())
        for b in batches:
            out = pa.array(decode_lists(raw, b.column("ids")), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, out], names=[*b.schema.names, "decoded"])

    return encoded.mapInArrow(run, f"{fields}, decoded string")


def model_path(spark: SparkSession, name: str = "piece_bpe_32k.model") -> str:
    """Where the model lies: the setting ``geoloom.tokenizers`` of the session, or the installed folder of public tokenizers."""
    return f"{spark.conf.get('geoloom.tokenizers', '/opt/tokenizers').rstrip('/')}/{name}"
