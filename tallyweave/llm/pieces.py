"""SentencePiece encoding and decoding by batched Viterbi search in numpy.

Text becomes units that no piece crosses (a run of escaped spaces with the word after it).
New units of a batch are searched together: units of one length form a matrix and advance
one character at a time. Hashes of all their substrings probe the sorted hashes of the
pieces; at each place the candidates that end there compete, and the winner's length is
the backpointer. Workers keep the ids of units they have seen.

Two scorings, by the model's own type:

* unigram: the sum of piece scores, as usual; an unknown character costs 10 below the
  least score.
* BPE: a path is allowed (0) or not (minus infinity). Merging leaves exactly the one
  path on which every neighbouring pair (a, b) is stable, that is, merging the characters
  of ``a b`` alone ends with ``a, b``. So the best last piece of every prefix is unique,
  and the same search with the same backpointers gives the ids that merging gives.
  Stability is tested for all candidates at once, by undoing the merges of both pieces
  from the last to the first: a pair breaks if at some time the pieces at the seam could
  have merged before the next merge beside it.

Characters outside the vocabulary become byte pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

SPACE = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NEVER = np.int64(1) << 40
_LEAD = np.uint64(44)
#: Bounds of a worker's memory, not of results: units kept, length from which units are cut, characters at a time.
_KEPT, _CUT_CHARS, _AT_ONCE = 800_000, 48, 4_000_000
_MARK = "\x1f"
UNIGRAM, BPE = 1, 2


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message; fixed-width values are skipped."""

    def varint() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    at = 0
    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, message[at : at + size]
            at += size
        else:
            at += 8 if kind == 1 else 4


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each of some ranges, in a row."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def _mix(h: np.ndarray) -> np.ndarray:
    """Spreads a hash over its leading bits; one to one."""
    return (h ^ (h >> np.uint64(29))) * _BASE


@dataclass
class PieceModel:
    """A model's pieces as sorted arrays (bounded by its vocabulary)."""

    kind: int
    names: list[str]
    scores: np.ndarray
    byte_ids: np.ndarray
    normal: np.ndarray

    @staticmethod
    def load(path: str) -> PieceModel:
        """Reads a model file; models that normalise text or define own symbols are refused."""
        import sentencepiece

        with open(path, "rb") as f:
            raw = f.read()
        processor = sentencepiece.SentencePieceProcessor(model_proto=raw)
        size = processor.get_piece_size()
        names = [processor.id_to_piece(i) for i in range(size)]
        kind, flags, types = UNIGRAM, {}, []
        for number, value in _fields(raw):
            if number == 1:
                types.append(next((v for n, v in _fields(value) if n == 3), 1))
            elif number == 2:
                kind = next((v for n, v in _fields(value) if n == 3), UNIGRAM)
            elif number == 3:
                flags = dict(_fields(value))
        if kind not in (UNIGRAM, BPE) or flags.get(2) or flags.get(3, 1) != 1 or flags.get(4, 1) != 0 or set(types) & {4, 5}:
            raise ValueError("only unigram and BPE models without normalisation and own symbols are read")
        bytes_ = np.array([i for i in range(size) if types[i] == 6])
        if len(bytes_) != 256:
            raise ValueError("a model with byte pieces is needed")
        normal = np.array([t == 1 for t in types])
        scores = np.array([processor.get_score(i) for i in range(size)], dtype=np.float32)
        return PieceModel(kind, names, scores, bytes_, normal)


class Encoder:
    """Viterbi search and decoding; built from a model on each worker, once."""

    def __init__(self, model: PieceModel):
        self.model = model
        self._ready = False

    def __reduce__(self):
        return Encoder, (self.model,)

    def _prepare(self) -> None:
        if self._ready:
            return
        m = self.model
        own = np.flatnonzero(m.normal)
        self.size = np.zeros(len(m.names), np.int64)
        self.hash = np.zeros(len(m.names), np.uint64)
        crossing = False
        for i in own:
            c = _codes(m.names[i])
            self.size[i] = len(c)
            h = np.uint64(0)
            for x in c:
                h = np.uint64((int(h) * int(_BASE) + int(x) + 1) & 0xFFFFFFFFFFFFFFFF)
            self.hash[i] = h
            crossing |= SPACE in m.names[i].lstrip(SPACE) or ("\n" in m.names[i] and m.names[i] != "\n")
        if crossing:
            raise ValueError("pieces that cross spaces are not supported")
        self.longest = int(self.size.max())
        self.power = np.cumprod(np.r_[np.uint64(1), np.full(2 * self.longest, _BASE)], dtype=np.uint64)
        mixed = _mix(self.hash[own])
        order = np.argsort(mixed, kind="stable")
        self.keys, self.ids = mixed[order], own[order]
        self.leading = np.zeros(1 << 20, bool)
        lead = self.keys >> _LEAD
        self.leading[lead] = True
        # Where the sorted keys with some leading bits begin, and how many share them at most.
        self.directory = np.searchsorted(lead, np.arange(1 << 20, dtype=np.uint64)).astype(np.int32).clip(max=len(self.keys) - 1)
        self.crowded = int(np.unique(lead, return_counts=True)[1].max())
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces have one hash")
        # The turn in which a piece is merged; single characters are there from the start.
        self.turn = np.full(len(m.names), -1, np.int64)
        long = own[self.size[own] > 1]
        # Pieces of one score share a turn; the leftmost place goes first.
        self.turn[long] = np.unique(-m.scores[long], return_inverse=True)[1]
        self.left = np.full(len(m.names), -1, np.int64)
        self.right = np.full(len(m.names), -1, np.int64)
        self.alive = m.normal.copy()
        if m.kind == BPE:
            self._split_pieces(long)
        self.bytes = [p.replace(SPACE, " ").encode() for p in m.names]
        for b, i in enumerate(m.byte_ids):
            self.bytes[i] = bytes([b])
        for i in range(len(m.names)):
            if not m.normal[i] and i not in set(m.byte_ids.tolist()):
                self.bytes[i] = b""
        self.unknown = np.float32(m.scores[own].min() - np.float32(10))
        self.units = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        pairs = {p[i : i + 2] for p in (m.names[j] for j in own) for i in range(len(p) - 1)}
        self.pairs = pairs
        self._forget()
        self._ready = True

    def _find(self, hashes: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Piece ids of substring hashes; -1 where there is none."""
        out = np.full(hashes.shape, -1, np.int32)
        hashes = _mix(hashes)
        lead = hashes >> _LEAD
        # Most substrings are no piece: their leading bits are in no key.
        maybe = np.nonzero(self.leading[lead])
        sought, at = hashes[maybe], self.directory[lead[maybe]]
        hit = self.keys[at] == sought
        for more in range(1, self.crowded):
            again = np.flatnonzero(~hit)
            step = np.minimum(self.directory[lead[maybe][again]] + more, len(self.keys) - 1)
            found = self.keys[step] == sought[again]
            at[again[found]], hit[again[found]] = step[found], True
        ids = self.ids[at]
        hit &= self.size[ids] == (size if np.isscalar(size) else size[maybe])
        out[maybe] = np.where(hit, ids, -1)
        return out

    def _split_pieces(self, long: np.ndarray) -> None:
        """Which two pieces each piece is merged from; pieces that merging never makes die."""
        for size in range(2, self.longest + 1):
            own = long[self.size[long] == size]
            prefix = self._prefixes(np.array([_codes(self.model.names[i]) for i in own]).reshape(len(own), size))
            for cut in range(1, size):
                a = self._find(prefix[:, cut], cut)
                b = self._find(prefix[:, size] - prefix[:, cut] * self.power[size - cut], size - cut)
                pick = np.flatnonzero((a >= 0) & (b >= 0))
                pick = pick[self.alive[a[pick]] & self.alive[b[pick]]]
                good = pick[self.stable(a[pick], b[pick], self.turn[own[pick]])]
                self.left[own[good]], self.right[own[good]] = a[good], b[good]
            self.alive[own[self.left[own] < 0]] = False
        made = long[self.alive[long]]
        if (np.maximum(self.turn[self.left[made]], self.turn[self.right[made]]) > self.turn[made]).any():
            raise ValueError("a piece of better rank than its parts")

    def _prefixes(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        for j in range(codes.shape[1]):
            out[:, j + 1] = out[:, j] * _BASE + codes[:, j] + np.uint64(1)
        return out

    def stable(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether merging ``a b`` leaves the seam, up to the turn ``before``."""
        out = np.ones(len(a), bool)
        at = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), _NEVER) if before is None else before.astype(np.int64)
        while len(at):
            seam = self._find(self.hash[x] * self.power[self.size[y]] + self.hash[y], self.size[x] + self.size[y])
            broken = (seam >= 0) & (self.turn[seam] < limit)
            out[at[broken]] = False
            # The later of the two merges is undone; of equal ones the right one is later.
            tx, ty = self.turn[x], self.turn[y]
            undo_x = tx > ty
            go = ~broken & ((tx >= 0) | (ty >= 0))
            # A merge at the seam lies left of one in y, so it wins a tie there.
            limit = np.where(undo_x, tx, ty + 1)[go]
            x, y = np.where(undo_x, self.right[x], x)[go], np.where(undo_x, y, self.left[y])[go]
            at = at[go]
        return out

    def search(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backpointers (piece length) and pieces (-1: unknown character) at each end; rows advance together."""
        rows, n = codes.shape
        prefix = self._prefixes(codes)
        top = min(self.longest, n)
        found = [None] + [
            self._find(prefix[:, s:] - prefix[:, : n + 1 - s] * self.power[s], s) for s in range(1, top + 1)
        ]
        back = np.zeros((rows, n + 1), np.int32)
        last = np.full((rows, n + 1), -1, np.int64)
        if self.model.kind == UNIGRAM:
            best = np.full((rows, n + 1), -np.inf, np.float32)
            best[:, 0] = 0
            for end in range(1, n + 1):
                for size in range(min(top, end), 0, -1):
                    piece = found[size][:, end - size]
                    score = best[:, end - size] + np.where(piece >= 0, self.model.scores[piece], self.unknown if size == 1 else -np.inf)
                    win = score > best[:, end]
                    best[win, end], back[win, end], last[win, end] = score[win], size, piece[win]
            return back, last
        for end in range(1, n + 1):
            sizes = range(1, min(top, end) + 1)
            grid = np.stack([found[s][:, end - s] for s in sizes], axis=1)
            row, k = np.nonzero(grid >= 0)
            piece = grid[row, k]
            start = end - 1 - k
            ok = self.alive[piece] & ((start == 0) | (back[row, start] > 0))
            row, k, piece, start = row[ok], k[ok], piece[ok], start[ok]
            before = last[row, start]
            # Nothing, or an unknown character, stands before: no seam to merge.
            free = (start == 0) | (before < 0)
            good = free.copy()
            test = np.flatnonzero(~free)
            good[test] = self.stable(before[test], piece[test])
            back[row[good], end] = k[good] + 1
            last[row[good], end] = piece[good]
            none = grid[:, 0] < 0
            back[none, end], last[none, end] = 1, -1
        return back, last

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each unit, the ids in a row)."""
        order: list[int] = []
        counts: list[np.ndarray] = []
        flat: list[np.ndarray] = []
        by_size: dict[int, list[int]] = {}
        for i, u in enumerate(units):
            by_size.setdefault(len(u), []).append(i)
        for empty in by_size.pop(0, ()):
            order.append(empty)
            counts.append(np.zeros(1, np.int64))
        for size, own in by_size.items():
            step = max(1, 1_000_000 // size)
            for at in range(0, len(own), step):
                part = own[at : at + step]
                codes = _codes("".join([units[i] for i in part])).reshape(len(part), size)
                back, last = self.search(codes)
                # All rows walk back together and mark the ends of their pieces.
                end = np.full(len(part), size)
                on_path = np.zeros(back.shape, bool)
                live = np.arange(len(part))
                while len(live):
                    on_path[live, end[live]] = True
                    end[live] -= back[live, end[live]]
                    live = live[end[live] > 0]
                rows, ends = np.nonzero(on_path)
                ids = last[rows, ends]
                if (ids < 0).any():
                    rows, ids = self._with_bytes(rows, ids, codes[rows, ends - 1])
                order += part
                counts.append(np.bincount(rows, minlength=len(part)))
                flat.append(ids.astype(np.int32))
        if not order:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        # Back to the order of the units.
        count, ids = np.concatenate(counts), np.concatenate([*flat, np.zeros(0, np.int32)])
        begin = np.cumsum(count) - count
        place = np.argsort(np.array(order), kind="stable")
        return count[place], ids[_spread(begin[place], count[place])]

    def _with_bytes(self, rows: np.ndarray, ids: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters become the pieces of their UTF-8 bytes."""
        out_rows, out_ids = [], []
        for r, i, c in zip(rows.tolist(), ids.tolist(), code.tolist()):
            found = [i] if i >= 0 else [self.model.byte_ids[x] for x in chr(c).encode("utf-8", "replace")]
            out_rows += [r] * len(found)
            out_ids += found
        return np.array(out_rows), np.array(out_ids)

    def _cut(self, unit: str) -> list[str]:
        """A unit, cut between characters that no piece has side by side.

        Short units are only looked at before their last character, a punctuation mark as a rule.
        """
        if len(unit) <= _CUT_CHARS:
            return [unit] if len(unit) < 2 or unit[-2:] in self.pairs else [unit[:-1], unit[-1]]
        cuts = [i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in self.pairs]
        return [unit[a:b] for a, b in zip([0, *cuts], [*cuts, len(unit)])]

    def _marked(self, text: str | None) -> str:
        """The escaped text with a mark between its units (empty units do no harm)."""
        if not text:
            return ""
        escaped = SPACE + text.replace(" ", SPACE)
        if SPACE + SPACE not in escaped:
            return escaped.replace(SPACE, _MARK + SPACE).replace("\n", f"{_MARK}\n{_MARK}")
        return _MARK.join(self.units.findall(escaped))

    def encode(self, texts: list[str | None]) -> pa.Array:
        """Lists of ids; null and empty texts have none."""
        self._prepare()
        parts, held, chars = [], [], 0
        for text in texts:
            held.append(text)
            chars += len(text or "")
            if chars > _AT_ONCE:
                parts.append(self._encode_held(held))
                held, chars = [], 0
        if held or not parts:
            parts.append(self._encode_held(held))
        return pa.concat_arrays(parts)

    def _encode_held(self, texts: list[str | None]) -> pa.Array:
        if any(_MARK in t for t in texts if t):
            # The mark itself is in a text: its units are listed one by one.
            lists = pa.array([self.units.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts], pa.list_(pa.string()))
        else:
            lists = pc.split_pattern(pa.array([self._marked(t) for t in texts], pa.string()), _MARK)
        coded = lists.flatten().dictionary_encode()
        units = coded.dictionary.to_pylist()
        if len(self.known) > _KEPT:
            self._forget()
        known = self.known
        number = np.fromiter((known.get(u, -1) for u in units), dtype=np.int64, count=len(units))
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            number[fresh] = self._learn([units[i] for i in fresh])
        unit = number[coded.indices.to_numpy()]
        size, begin = self.sizes[unit], self.begins[unit]
        ids = self.flat[_spread(begin, size)]
        ends = np.r_[0, np.cumsum(size)][lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.begins, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, units: list[str]) -> np.ndarray:
        """Numbers of units that were not known; a unit of several parts is put together from theirs."""
        known = self.known
        cut = [self._cut(u) for u in units]
        parts = list({p for c in cut for p in c if p not in known})
        count, ids = self._encode_units(parts)
        known.update(zip(parts, range(len(self.sizes), len(self.sizes) + len(parts))))
        self._add(count, ids)
        whole = [i for i, c in enumerate(cut) if len(c) > 1]
        if whole:
            part = np.array([known[p] for i in whole for p in cut[i]])
            upto = np.r_[0, np.cumsum(self.sizes[part])][np.r_[0, np.cumsum([len(cut[i]) for i in whole])]]
            known.update(zip((units[i] for i in whole), range(len(self.sizes), len(self.sizes) + len(whole))))
            self._add(np.diff(upto), self.flat[_spread(self.begins[part], self.sizes[part])])
        return np.array([known[u] for u in units])

    def _add(self, count: np.ndarray, ids: np.ndarray) -> None:
        self.begins = np.r_[self.begins, len(self.flat) + np.cumsum(count) - count]
        self.sizes = np.r_[self.sizes, count]
        self.flat = np.r_[self.flat, ids]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD."""
        self._prepare()
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_ROW = "n_tokens bigint, ids array<int>"


def encode_texts(docs: DataFrame, model: PieceModel) -> DataFrame:
    """``(doc_id, n_tokens, ids, text)``: ids of each whole text, and the text decoded from them.

    A literal U+2581 in a text is the model's sign for a space and decodes as one. Null
    and empty texts have no ids and decode to an empty text; ids, null or repeated, pass
    through. An empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Encoder(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                lists = encoder.encode(batch.column("text").to_pylist())
                texts = [encoder.decode(ids) for ids in lists.to_pylist()]
                sizes = pa.array(np.diff(lists.offsets.to_numpy()).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), sizes, lists, pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "text"]
                )

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id bigint, {_ROW}, text string")
