"""SentencePiece encoding and decoding, giant texts by a max-plus scan over chunks.

Encoding is the best path through a lattice of pieces. A chunk of a giant text is summed up by a transfer matrix: for
each state at its left edge (the piece that begins before the edge, and so how far it reaches) and each state at its
right edge, the best score between them, or minus infinity. Max-plus products of such matrices are associative, so all
edges' states on the whole text's best path follow from a scan; each chunk is then traced back on its own.

Two lattices are served. ``unigram``: the score of a path is the sum of its pieces' scores. ``bpe``: the path that
merging by rank gives is the one on which every two neighbours, merged afresh, come out as themselves; such steps score
0, all others minus infinity. (Merging by rank isn't the best sum of scores, so that model needs this lattice to give
the library's ids.)

Where no piece holds two neighbouring characters, all paths meet: there is one state, the matrix has rank one, and the
stretch up to the next such place is encoded once for each distinct string. A text of one chunk has one state at
either edge, so its scan is that of its stretches.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import give_back, keyed, partitions_of, per_process, same_document, saved, slices
from foliospark.llm.runs import Runs

CHUNK_CHARS = 16_384
BLANK = "▁"
#: Prefixes that a worker remembers, and the longest of them; runs between blanks that it remembers; characters of texts
#: that are encoded together.
CACHE, _CACHE_LEN, _RUNS, _TOGETHER = 100_000, 48, 800_000, 250_000
_NONE = float("-inf")


def loaded(model_file: str, cache: int) -> Lattice:
    return per_process(("sentencepieces", model_file, cache), lambda: Lattice.load(model_file, cache))


class Lattice:
    """Pieces with (id, score), ``bpe`` or ``unigram``, and the ids of the 256 bytes for characters without a piece."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], bpe: bool, prefix: bool = True, cache: int = CACHE):
        self.pieces, self.byte_ids, self.bpe, self.prefix, self.cache = pieces, byte_ids, bpe, prefix, cache
        self.longest = max(map(len, pieces), default=1)
        order = {s: k for k, s in enumerate(sorted({s for _, s in pieces.values()}, reverse=True))}
        self.rank = {p: order[s] for p, (_, s) in pieces.items()}
        self._starts = None
        self.last_merge = lru_cache(None)(self._last_merge)
        self.joint = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.unknown = min((s for _, s in pieces.values()), default=0.0) - 10
        self.fits = lru_cache(cache)(self._fits)
        self.ends = {p[i:]: None for p in pieces for i in range(1, len(p))} | {p: s for p, (_, s) in pieces.items()}
        self.nothing = (0.0, "", b"")
        self.memo: dict[str, tuple[float, str, bytes]] = {}
        self.runs: Runs | None = None
        self.packed = {p: i.to_bytes(4, "little") for p, (i, _) in pieces.items()}
        # Paths meet before blanks and beside line feeds, if no piece has a blank after another character or a line feed
        # beside one.
        self.plain = not any(x[1] == BLANK != x[0] or "\n" in x for x in self.joint)
        self.texts = {i: p.encode() for p, (i, _) in pieces.items()} | {b: bytes([k]) for k, b in enumerate(byte_ids)}

    @property
    def starts(self) -> dict[str, float | None]:
        """Of each beginning of a piece: its score if it is a piece, else None. Made when it is first asked for."""
        if self._starts is None:
            self._starts = {p[:i]: None for p in self.pieces for i in range(1, len(p))} | {p: s for p, (_, s) in self.pieces.items()}
        return self._starts

    @classmethod
    def load(cls, model_file: str, cache: int = CACHE) -> Lattice:
        """Of a SentencePiece model whose normaliser leaves text alone, with byte fallback."""
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or model.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models without normalisation are served")
        normal = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == 1}
        at = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 6}
        return cls(normal, [at[f"<0x{b:02X}>"] for b in range(256)], model.trainer_spec.model_type == 2, norm.add_dummy_prefix, cache)

    def normalised(self, text: str) -> str:
        return (BLANK if self.prefix and text else "") + text.replace(" ", BLANK)

    def merged(self, text: str, stop: int = 1) -> list[str]:
        """Merging by rank, down to ``stop`` parts: the best-scored pair first, of equal ones the leftmost."""
        parts = list(text)
        while True:
            if len(parts) <= stop:
                return parts
            best, at = None, -1
            for i in range(len(parts) - 1):
                got = self.pieces.get(parts[i] + parts[i + 1])
                if got and (best is None or got[1] > best):
                    best, at = got[1], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _merge_order(self, token: str) -> int:
        """When merging makes a token; -1 for single characters, which are there from the start."""
        return self.rank.get(token, -1) if len(token) > 1 else -1

    def _last_merge(self, token: str) -> tuple[str, str] | None:
        """The two parts that merging joins last to make a piece; None if it never makes that piece whole."""
        parts = self.merged(token, stop=2)
        return (parts[0], parts[1]) if len(parts) == 2 and len(self.merged(token)) == 1 else None

    def _fits(self, left: str, right: str) -> bool:
        """Whether merging ``left + right`` gives these two again (without left: whether it gives ``right``).

        Merges are undone from the latest back, beside the seam only; the seam holds if, at no time, a merge across it
        would have come before the one that is undone next. Of equal scores, the leftmost merge comes first.
        """
        for token in (left, right):
            if len(token) > 1 and self.last_merge(token) is None:
                return False
        limit = len(self.pieces) + 1
        while left:
            across = self.rank.get(left + right)
            if across is not None and across < limit:
                return False
            made_left, made_right = self._merge_order(left), self._merge_order(right)
            if made_left < 0 and made_right < 0:
                break
            if made_left > made_right:
                limit, left = made_left, self.last_merge(left)[1]
            else:
                limit, right = made_right + 1, self.last_merge(right)[0]
        return True

    def tokens(self, text: str, at: int):
        first = text[at]
        if first not in self.pieces:
            yield first, self.unknown
        get = self.starts.get
        for end in range(at + 1, min(len(text), at + self.longest) + 1):
            part = text[at:end]
            score = get(part, False)
            if score is False:
                break
            if score is not None:
                yield part, score

    def forward(self, text: str, lo: int, hi: int, best: dict[int, tuple]) -> dict[int, tuple]:
        """best: place -> (score, start of the token that ends there, token). Grown by tokens that start in [lo, hi)."""
        fits, bpe = self.fits, self.bpe
        for at in range(lo, hi):
            here = best.get(at)
            if here is None:
                continue
            for token, score in self.tokens(text, at):
                end = at + len(token)
                if bpe:
                    if end not in best and fits(here[2], token):
                        best[end] = (0.0, at, token)
                elif end not in best or here[0] + score > best[end][0]:
                    best[end] = (here[0] + score, at, token)
        return best

    def best_prefix(self, text: str) -> tuple[float, str, bytes]:
        """(score, last token, ids) of the best path over a text from one state: Viterbi's recursion on prefixes.

        The best path to a place doesn't depend on what follows, so prefixes are kept and shared between texts. For
        ``bpe`` just one token can end a text's path, and the longest that fits the path before it is that one.
        """
        got = self.memo.get(text)
        if got is not None:
            return got
        n, get, best = len(text), self.ends.get, None
        here = [] if text[-1] in self.pieces else [(text[-1], self.unknown)]
        for start in range(n - 1, max(-1, n - 1 - self.longest), -1):
            part = text[start:]
            score = get(part, False)
            if score is False:
                break
            if score is not None:
                here.append((part, score))
        for part, score in reversed(here):
            before = self.best_prefix(text[: n - len(part)]) if len(part) < n else self.nothing
            if self.bpe:
                if self.fits(before[1], part):
                    best = (0.0, part, before)
                    break
            elif best is None or before[0] + score > best[0]:
                best = (before[0] + score, part, before)
        score, part, before = best
        got = (score, part, before[2] + (self.packed.get(part) or self._unknown(part)))
        if len(self.memo) >= self.cache:
            self.memo.clear()
        self.memo[text] = got
        return got

    @staticmethod
    def back(best: dict[int, tuple], end: int, begin: int) -> list[str]:
        out = []
        while end > begin:
            _, start, token = best[end]
            out.append(token)
            end = start
        return out[::-1]

    def ids(self, tokens: list[str]) -> bytes:
        get, unknown = self.packed.get, self._unknown
        return b"".join([get(t) or unknown(t) for t in tokens])

    def _unknown(self, character: str) -> bytes:
        return np.array([self.byte_ids[b] for b in character.encode("utf-8", "surrogatepass")], dtype="<u4").tobytes()

    def _stretches(self, text: str) -> list[str]:
        joint, cuts = self.joint, [0]
        cuts += [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in joint]
        return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])] if text else []

    def _stretch(self, text: str) -> bytes:
        """Ids of a text with one state at either edge and none inside."""
        if len(text) <= _CACHE_LEN:
            return self.best_prefix(text)[2]
        n = len(text)
        return self.ids(self.back(self.forward(text, 0, n, {0: (0.0, 0, "")}), n, 0))

    def _slow(self, text: str) -> bytes:
        """Ids of a text with one state at either edge."""
        return b"".join(map(self._stretch, self._stretches(text)))

    def stretches(self, texts: list[str]) -> list[bytes]:
        """Ids of normalised texts, each with one state at either edge, as little-endian unsigned 32-bit integers.

        Paths meet before blanks and at line feeds; what stands between is a run, of which ids are remembered. A run of
        one blank and other characters has a mark; other blanks, and all before them, are long names of their own.
        """
        out, lo = [], 0
        if not self.plain:
            return [self._slow(t) for t in texts]
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= _TOGETHER):
                size += len(texts[hi])
                hi += 1
            out += self._together(texts[lo:hi])
            lo = hi
        return out

    def _together(self, texts: list[str]) -> list[bytes]:
        if self.runs is None or self.runs.n > _RUNS:
            self._keep(_RUNS // 4)
        parts = [t.replace(BLANK, " ").encode("utf-8", "surrogatepass") for t in texts]
        raw = b"\n" * 8 + b"\n".join(parts) + b"\n" * 8
        each = np.frombuffer(raw, np.uint8)
        blank, line = each == 32, each == 10
        between = blank | line
        edges = np.flatnonzero(between[1:] != between[:-1]) + 1
        start, end = edges[::2], edges[1::2]
        # Runs of blanks, by where they begin and end.
        gaps = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        low, high = gaps[::2], gaps[1::2]
        before = np.zeros(len(each), np.int64)
        before[high] = high - low
        blanks = before[start]
        known = np.full(len(each), -1, np.int64)
        known[line] = self.line[0]
        one = np.flatnonzero(blanks <= 1)
        known[start[one]] = self.runs.numbers(raw, start[one], end[one], self._learn, 32 * blanks[one])
        # More blanks before other characters go with them; blanks before a line feed or the end are a run.
        more, alone = np.flatnonzero(blanks > 1), line[high]
        odd_start = np.r_[start[more] - blanks[more], low[alone]]
        odd_end = np.r_[end[more], high[alone]]
        if len(odd_start):
            known[odd_start] = self._odd(raw, odd_start, odd_end)
        known[8 + np.cumsum([len(p) + 1 for p in parts[:-1]], dtype=np.int64) - 1] = -1  # between texts
        known[:8] = known[len(raw) - 8 :] = -1
        at = np.flatnonzero(known >= 0)
        numbers = known[at]
        self.runs.asked[: self.runs.n] += np.bincount(numbers, minlength=self.runs.n)
        ids, size = self.runs.ids(numbers)
        until = 8 + np.cumsum([len(p) + 1 for p in parts])
        ends = 4 * np.r_[0, np.cumsum(size, dtype=np.int64)][np.r_[0, np.searchsorted(at, until)]]
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def _odd(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> list[int]:
        names, held = [(raw[a:b], -1) for a, b in zip(start.tolist(), end.tolist())], self.runs.long
        if unknown := dict.fromkeys(x for x in names if x not in held):
            zero = np.zeros(len(unknown), np.uint64)
            fresh = self.runs.add(zero, zero, zero)
            held.update(zip(unknown, fresh.tolist()))
            self._learn(fresh, [x for x, _ in unknown], np.zeros(len(unknown)))
        return [held[x] for x in names]

    def _learn(self, numbers: np.ndarray, names: list[bytes], marks: np.ndarray) -> None:
        """Gives new runs their ids; the stretches of a run of several are runs of their own."""
        cuts = [
            self._stretches((BLANK if m > 0 else "") + x.decode("utf-8", "surrogatepass").replace(" ", BLANK))
            for x, m in zip(names, marks.tolist())
        ]
        alone = [k for k, cut in enumerate(cuts) if len(cut) == 1]
        if alone:
            made = [self._stretch(cuts[k][0]) for k in alone]
            self.runs.give(numbers[alone], np.frombuffer(b"".join(made), "<u4"), np.array([len(x) // 4 for x in made]))
        several = [k for k, cut in enumerate(cuts) if len(cut) > 1]
        if several:
            parts = list(chain.from_iterable(cuts[k] for k in several))
            mark = np.array([32 if p[0] == BLANK and len(p) > 1 else 0 for p in parts])
            raw = [(p[1:] if m else p).replace(BLANK, " ").encode("utf-8", "surrogatepass") for p, m in zip(parts, mark.tolist())]
            ends = 8 + np.cumsum([len(x) for x in raw])
            starts = ends - [len(x) for x in raw]
            of_parts = self.runs.numbers(b"\n" * 8 + b"".join(raw) + b"\n" * 8, starts, ends, self._learn, mark)
            ids, size = self.runs.ids(of_parts)
            counts = np.array([len(cuts[k]) for k in several])
            self.runs.give(numbers[several], ids, np.add.reduceat(size, np.cumsum(counts) - counts))

    def rest(self) -> None:
        """Between tasks a worker that is to remember less than ``CACHE`` keeps that many of the most frequent runs."""
        if self.cache < CACHE:
            self.memo.clear()
            if self.runs is not None and self.runs.n > self.cache:
                self._keep(self.cache)
        give_back()

    def _keep(self, most: int) -> None:
        self.runs = self.runs.frequent(most) if self.runs else Runs(np.dtype("<u4"))
        self.line = self.runs.add(*np.zeros((3, 1), np.uint64))
        self._learn(self.line, [b"\n"], np.zeros(1))

    def encode(self, text: str) -> bytes:
        """Ids of a text of one chunk."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return self.stretches([self.normalised(t) for t in texts])

    def decode(self, ids: bytes) -> str:
        """The text of ids. (A text that holds U+2581 itself comes back with a blank there, as from the library.)"""
        raw = b"".join(map(self.texts.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        text = raw.decode("utf-8", "surrogatepass").replace(BLANK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text

    # Chunks. ``text`` holds the chunk [lo, hi) and, on each side that goes on, ``longest`` characters of its neighbours.

    def states(self, text: str, edge: int) -> list[tuple[int, str]]:
        """Tokens that start before an edge and end at it or beyond, as (place of the end, token)."""
        out = []
        for at in range(max(0, edge - self.longest), edge):
            out += [(at + len(t), t) for t, _ in self.tokens(text, at) if at + len(t) >= edge]
        return out

    def _edges(self, text, lo, hi, first, last):
        entry = [(lo, "")] if first else self.states(text, lo)
        leave = None if last else self.states(text, hi)
        near = next((i for i in range(lo + 1, hi) if text[i - 1 : i + 1] not in self.joint), None)
        far = next((i for i in range(hi - 1, lo, -1) if text[i - 1 : i + 1] not in self.joint), None)
        return entry, leave, near, far

    def factors(self, text: str, lo: int, hi: int, first: bool, last: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """The max-plus matrix from states at lo to states at hi and None; where all paths meet inside, a column and a row
        of which it is the sum."""
        entry, leave, near, far = self._edges(text, lo, hi, first, last)

        def out_of(best):
            if leave is None:
                return [best[hi][0] if hi in best else _NONE]
            got = []
            for end, token in leave:
                here = best.get(end - len(token))
                score = 0.0 if self.bpe else self.pieces.get(token, (0, self.unknown))[1]
                fine = here is not None and (not self.bpe or self.fits(here[2], token))
                got.append(here[0] + score if fine else _NONE)
            return got

        rows = [self.forward(text, lo, near or hi, {end: (0.0, end, token)}) for end, token in entry]
        if near is None:
            return np.array([out_of(b) for b in rows]), None
        inward = np.array([b[near][0] if near in b else _NONE for b in rows])
        middle = 0.0 if self.bpe else self.forward(text[near:far], 0, far - near, {0: (0.0, 0, "")})[far - near][0]
        outward = np.array(out_of(self.forward(text, far, hi, {far: (0.0, far, "")})))
        return inward[:, None] + middle, outward[None, :]

    def trace(self, text: str, lo: int, hi: int, first: bool, last: bool, enter: int, leave_by: int) -> bytes:
        """Ids of the tokens that start in [lo, hi) on the best path between two states."""
        entry, leave, near, far = self._edges(text, lo, hi, first, last)
        begin, token = entry[enter]
        end, tail = (hi, []) if leave is None else (leave[leave_by][0] - len(leave[leave_by][1]), [leave[leave_by][1]])
        best = self.forward(text, lo, near or hi, {begin: (0.0, begin, token)})
        if near is None:
            return self.ids(self.back(best, end, begin) + tail)
        head = self.ids(self.back(best, near, begin))
        middle = self.stretches([text[near:far]])[0]
        best = self.forward(text, far, hi, {far: (0.0, far, "")})
        return head + middle + self.ids(self.back(best, end, far) + tail)


class Transfer:
    """A max-plus matrix, or, where all paths meet on the way, the sum of a column and a row (``whole`` is None then)."""

    __slots__ = ("whole", "column", "row")

    def __init__(self, whole=None, column=None, row=None):
        self.whole, self.column, self.row = whole, column, row

    @classmethod
    def of(cls, factors: tuple[np.ndarray, np.ndarray | None]) -> Transfer:
        return cls(factors[0]) if factors[1] is None else cls(None, factors[0].ravel(), factors[1].ravel())

    def then(self, other: Transfer) -> Transfer:
        """The max-plus product, which is associative."""
        if self.whole is not None and other.whole is not None:
            return Transfer((self.whole[:, :, None] + other.whole[None, :, :]).max(axis=1))
        if self.whole is not None:
            return Transfer(None, (self.whole + other.column[None, :]).max(axis=1), other.row)
        return Transfer(None, self.column, other.into(self.row))

    def into(self, scores: np.ndarray) -> np.ndarray:
        """The best score of each state at the right edge, from scores of those at the left edge."""
        if self.whole is not None:
            return (scores[:, None] + self.whole).max(axis=0)
        return (scores + self.column).max() + self.row

    def before(self, scores: np.ndarray, state: int) -> int:
        """The state at the left edge of the best path to a state at the right edge."""
        return int((scores + (self.column if self.whole is None else self.whole[:, state])).argmax())

    def packed(self) -> tuple[int, bytes]:
        """Rows (less than 0: of a column and a row) and numbers."""
        if self.whole is not None:
            return len(self.whole), self.whole.tobytes()
        return -len(self.column), self.column.tobytes() + self.row.tobytes()

    @classmethod
    def unpacked(cls, n: int, raw: bytes) -> Transfer:
        flat = np.frombuffer(raw)
        return cls(flat.reshape(n, -1)) if n > 0 else cls(None, flat[:-n], flat[-n:])


def best_states(transfers: list[Transfer], enter: int = 0, leave: int | None = None) -> list[int]:
    """The state at each matrix' right edge on the best path from a state to a state (None: the best one)."""
    first = transfers[0]
    scores = [first.whole[enter] if first.whole is not None else first.column[enter] + first.row]
    for t in transfers[1:]:
        scores.append(t.into(scores[-1]))
    out = [int(scores[-1].argmax()) if leave is None else leave]
    for t, s in zip(transfers[:0:-1], scores[-2::-1]):
        out.append(t.before(s, out[-1]))
    return out[::-1]


_CHUNKS = "doc_id bigint, text_hash bigint, chunk int, n_chunks int, lo int, hi int, text string"
_DOC = ["doc_id", "text_hash"]
_KEY = [*_DOC, "chunk"]
#: Matrices that one step of the scan combines.
FAN = 64
#: Rows of 32 bytes up to which states are sent to all tasks; beyond that, chunks and states are dealt out and joined.
_BROADCAST_ROWS = 1_000_000


def _cut(model_file: str, size: int, cache: int):
    def run(batches):
        lattice, seen = loaded(model_file, cache), set()
        for batch in batches:
            for doc_id, text_hash, text in zip(*(batch.column(c) for c in ("doc_id", "text_hash", "text"))):
                if (key := (doc_id.as_py(), text_hash.as_py())) in seen:
                    continue  # a repeated row has the same chunks
                seen.add(key)
                whole = lattice.normalised(text.as_py())
                n, pad = -(-len(whole) // size), lattice.longest
                for k in range(n):
                    a, b = max(0, k * size - pad), min(len(whole), (k + 1) * size + pad)
                    row = [*key, k, n, k * size - a, min(len(whole), (k + 1) * size) - a, whole[a:b]]
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v], t) for v, t in zip(row, kinds)], names=[*_KEY, "n_chunks", "lo", "hi", "text"]
                    )

    return run


def _first_of_each(batches):
    """Of sorted rows, those whose key differs from that of the row before."""
    last = None
    for batch in batches:
        keep = []
        for key in zip(*(batch.column(c).to_pylist() for c in _KEY)):
            keep.append(key != last)
            last = key
        if any(keep):
            yield batch.filter(pa.array(keep))


def _runs(batches, key: list[str], columns: list[str]):
    """(key, rows) of each run of equal keys in sorted rows; a run is held whole."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in [*key, *columns])):
            if row[: len(key)] != now:
                if held:
                    yield now, held
                now, held = row[: len(key)], []
            held.append(row[len(key) :])
    if held:
        yield now, held


def _dealt(rows: DataFrame, parts: int, group: list[str], order: str) -> DataFrame:
    """Groups together and in order. (With the number given, Spark doesn't merge small partitions into one task.)"""
    return rows.repartition(parts, *group).sortWithinPartitions(*group, order)


_NODES = "doc_id bigint, text_hash bigint, above int, at int, n int, scores binary"
_STATES = "doc_id bigint, text_hash bigint, at int, enter int, leave_by int"


def _states(matrices: DataFrame, most: int, parts: int, fan: int) -> DataFrame:
    """doc_id, text_hash, at, enter, leave_by: of each chunk, the states at its edges on the whole text's best path.

    A tree of max-plus products: each step up combines ``fan`` neighbours, until a text has ``fan`` matrices at most;
    then each step down finds the states inside of what a step up combined. No task holds more than ``fan`` matrices.
    """

    def up(batches):
        for (doc_id, text_hash, above), rows in _runs(batches, [*_DOC, "above"], ["n", "scores"]):
            whole = Transfer.unpacked(*rows[0])
            for row in rows[1:]:
                whole = whole.then(Transfer.unpacked(*row))
            n, scores = whole.packed()
            made = [[doc_id], [text_hash], [above // fan], [above], [n], [scores]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(made, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))],
                names=[*_DOC, "above", "at", "n", "scores"],
            )

    def down(batches):
        for key, rows in _runs(batches, [*_DOC, "above", "enter", "leave_by"], ["at", "n", "scores"]):
            enter, leave = key[3], key[4]
            states = best_states([Transfer.unpacked(n, scores) for _, n, scores in rows], enter, leave)
            made = [[key[0]] * len(rows), [key[1]] * len(rows), [r[0] for r in rows], [enter, *states[:-1]], states]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(made, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))],
                names=[*_DOC, "at", "enter", "leave_by"],
            )

    levels = [matrices]
    while most > fan:
        levels.append(saved(_dealt(levels[-1], parts, [*_DOC, "above"], "at").mapInArrow(up, _NODES), "products"))
        most = -(-most // fan)
    free = levels[-1].withColumn("enter", F.lit(0)).withColumn("leave_by", F.lit(None).cast("int"))
    inside = ["above", "enter", "leave_by"]
    found = _dealt(free, parts, [*_DOC, *inside], "at").mapInArrow(down, _STATES)
    for level in levels[-2::-1]:
        found = saved(found, "states")
        on = same_document(level, found) & (level["above"] == found["at"])
        fixed = level.join(found, on).select(*(level[c] for c in level.columns), "enter", "leave_by")
        found = _dealt(fixed, parts, [*_DOC, *inside], "at").mapInArrow(down, _STATES)
    return found


def _giants(docs: DataFrame, model_file: str, size: int, cache: int, fan: int = FAN) -> DataFrame:
    """doc_id, text_hash, ids of texts of several chunks, each document once."""
    parts = partitions_of(docs)
    dealt = docs.mapInArrow(_cut(model_file, size, cache), _CHUNKS).repartition(parts, *_KEY).sortWithinPartitions(*_KEY)
    chunks = saved(dealt.mapInArrow(_first_of_each, _CHUNKS), "chunks")

    def transfers(batches):
        lattice = loaded(model_file, cache)
        for batch in slices(batches, 64):
            made = [
                Transfer.of(lattice.factors(r["text"], r["lo"], r["hi"], r["chunk"] == 0, r["chunk"] == r["n_chunks"] - 1)).packed()
                for r in batch.to_pylist()
            ]
            at = batch.column("chunk").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in _DOC), pa.array([k // fan for k in at], pa.int32()), pa.array(at, pa.int32()),
                 pa.array([n for n, _ in made], pa.int32()), pa.array([raw for _, raw in made], pa.binary())],
                names=[*_DOC, "above", "at", "n", "scores"],
            )

    most = chunks.agg(F.max("n_chunks")).first()[0] or 0
    matrices = chunks.mapInArrow(transfers, _NODES)
    states = saved(_states(saved(matrices, "matrices") if most > fan else matrices, most, parts, fan), "states")
    if states.count() <= _BROADCAST_ROWS:
        states = F.broadcast(states)
    on = same_document(chunks, states) & (chunks["chunk"] == states["at"])
    ready = chunks.join(states, on).select(*(chunks[c] for c in chunks.columns), "enter", "leave_by")

    def traced(batches):
        lattice = loaded(model_file, cache)
        for batch in slices(batches, 64):
            ids = [
                lattice.trace(r["text"], r["lo"], r["hi"], r["chunk"] == 0, r["chunk"] == r["n_chunks"] - 1, r["enter"], r["leave_by"])
                for r in batch.to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _KEY), pa.array(ids, pa.binary())], names=[*_KEY, "ids"])
        lattice.rest()

    def joined(batches):
        for key, rows in _runs(batches, _DOC, ["ids"]):
            made = [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([b"".join(r[0] for r in rows)], pa.binary())]
            yield pa.RecordBatch.from_arrays(made, names=[*_DOC, "ids"])

    traces = ready.mapInArrow(traced, "doc_id bigint, text_hash bigint, chunk int, ids binary")
    return _dealt(traces, parts, _DOC, "chunk").mapInArrow(joined, "doc_id bigint, text_hash bigint, ids binary")


def encode(docs: DataFrame, model_file: str, chunk_chars: int = CHUNK_CHARS, cache: int = CACHE) -> DataFrame:
    """One row for each input row: doc_id, text_hash, ids (little-endian unsigned 32-bit integers, as binary).

    Null and empty texts have no ids. Repeated rows each get their row; an empty table gives an empty one. Texts longer
    than ``chunk_chars`` characters are split into chunks of that size, wherever the cut falls, and no task holds more
    than one of them to encode it.
    """
    if chunk_chars < Lattice.load(model_file).longest:
        raise ValueError("a chunk must be as long as the longest piece")
    every = keyed(docs)
    short = every.filter(F.length("text") < chunk_chars)
    long = every.filter(F.length("text") >= chunk_chars)

    def run(batches):
        lattice = loaded(model_file, cache)
        for part in slices(batches, 500):
            ids = lattice.encode_all(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), part.column("text_hash"), pa.array(ids, pa.binary())],
                names=["doc_id", "text_hash", "ids"],
            )
        lattice.rest()

    made = short.mapInArrow(run, "doc_id bigint, text_hash bigint, ids binary")
    giants = _giants(long, model_file, chunk_chars, cache)
    rows = long.select(F.col("doc_id").cast("long").alias("doc_id"), "text_hash")
    return made.unionByName(rows.join(giants, same_document(rows, giants)).select(rows["doc_id"], rows["text_hash"], "ids"))


def decode(encoded: DataFrame, model_file: str, column: str = "decoded", cache: int = CACHE) -> DataFrame:
    """``encoded`` and the text that its ``ids`` stand for."""
    schema = T.StructType([*encoded.schema, T.StructField(column, T.StringType())])

    def run(batches):
        lattice = loaded(model_file, cache)
        for batch in slices(batches, 500):
            texts = [lattice.decode(i.as_py()) for i in batch.column("ids")]
            yield batch.append_column(column, pa.array(texts, pa.string()))

    return encoded.mapInArrow(run, schema)


def digest(docs: DataFrame, model_file: str, chunk_chars: int = CHUNK_CHARS, cache: int = CACHE) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, round_trip (whether decoding gives the text back)."""
    back = decode(encode(docs, model_file, chunk_chars, cache), model_file, cache=cache)
    return back.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"),
        (F.xxhash64("decoded") == F.col("text_hash")).alias("round_trip"),
    )
