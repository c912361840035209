"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The model file of a public BPE tokenizer is read on the driver; its tables go to
the tasks. A text becomes U+2581 and the text with U+2581 for each space; no piece has that sign
behind another character, so it is cut before each run of it and every distinct
word is encoded once. All new words of a batch are flat symbol arrays: a round
finds the best-ranked pair of each word (a segmented minimum), merges it at its
leftmost place, and compacts; a word without a pair is done. A rank below which
no longer piece can form is merged at all its places in one round, with the
same result. Long words (runs of thousands of characters) would take a round for each rank over
all of their symbols; after ``MAX_ROUNDS`` the symbols of the words that are left are linked instead of
compacted, and a round visits the places of its rank alone, in all these words at once.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import map_arrow, with_text
from .text import run_hashes, string_buffers, text_chunks

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MAX_ROUNDS = 64
#: Distinct words whose ids a task remembers before it starts anew.
MEMORY_WORDS = 150_000
#: Bytes of text that are worked on together; the arrays take about 100 times as much.
CHUNK_BYTES = 1 << 20
_NONE = np.iinfo(np.int64).max


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[i : i + n]
            i += n


def _bucket(key: np.ndarray) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


class BpeModel:
    """Tables of a model file, as numpy arrays that can be sent to tasks."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        scores, kinds = [], []
        trainer, normalizer = {}, {}
        for field, value in _fields(data):
            if field == 1:
                got = dict(_fields(value))
                self.pieces.append(got[1].decode())
                scores.append(struct.unpack("<f", got[2])[0] if 2 in got else 0.0)
                kinds.append(got.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        self.kinds = np.array(kinds)
        self.prefix = bool(normalizer.get(3, 1))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0):
            raise ValueError("only BPE models with byte fallback are supported")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or np.isin(self.kinds, (USER, UNUSED)).any():
            raise ValueError("only models with identity normalisation and without user-defined or unused pieces are supported")
        self.size = len(self.pieces)
        self.bos, self.eos, self.unk = trainer.get(41, 1), trainer.get(42, 2), trainer.get(40, 0)
        self.unk_surface = trainer.get(44, b" \xe2\x81\x87 ")
        self.byte_ids = np.zeros(256, np.int64)
        for i in np.flatnonzero(self.kinds == BYTE):
            self.byte_ids[int(self.pieces[i][1:-1], 16)] = i
        ranks = np.unique(-np.array(scores), return_inverse=True)[1]
        ids = {p: i for i, p in enumerate(self.pieces) if kinds[i] == NORMAL}
        self.symbols = {p: i for p, i in ids.items() if len(p) == 1}
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in ids)
        sym = lambda s: ids.get(s, self.size + ord(s) if len(s) == 1 else None)
        keys, rank, merged = [], [], []
        lowest: dict[int, int] = {}  # by rank of a piece: the lowest rank of a longer piece with it as one half
        for p, i in ids.items():
            for c in range(1, len(p)):
                a, b = sym(p[:c]), sym(p[c:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    rank.append(ranks[i])
                    merged.append(i)
                    for half in (a, b):
                        if half < self.size:
                            lowest[ranks[half]] = min(int(ranks[i]), lowest.get(ranks[half], _NONE))
        order = np.argsort(np.array(keys))
        self.keys, self.rank, self.merged = (np.array(x, np.int64)[order] for x in (keys, rank, merged))
        where = _bucket(self.keys)
        self.buckets, self.crowded = np.zeros(1 << 20, np.int64), np.bincount(where, minlength=1 << 20) > 1
        self.buckets[where] = np.arange(len(self.keys))
        self.alone = np.array([lowest.get(r, _NONE) <= r for r in range(int(ranks.max()) + 1)])  # merged one place at a time
        shown = [b"" if k == CONTROL else self.unk_surface if k == UNKNOWN else bytes([int(p[1:-1], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, kinds, strict=True)]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_at = np.concatenate([[0], np.cumsum([len(s) for s in shown])])
        self.spaced = np.array([k == NORMAL and p.startswith(SPACE) for p, k in zip(self.pieces, kinds, strict=True)])

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or _NONE) and place in the tables of each pair."""
        key = left << 32 | right
        at = self.buckets[_bucket(key)]
        far = (self.keys[at] != key) & self.crowded[_bucket(key)]
        if far.any():
            at[far] = np.minimum(np.searchsorted(self.keys, key[far]), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE), at

    def encode_words(self, code: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words as code points and the number in each: ids of all words in one array, and where each word begins (n + 1)."""
        sym = self._symbols()[code]
        word = np.repeat(np.arange(len(chars)), chars)
        done_sym, done_word = [], []
        rank, at = self._pairs(sym, word)
        rounds = 0
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, first)
            count = np.diff(np.append(first, len(sym)))
            over = np.repeat(best == _NONE, count)
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                sym, word, rank, at = (x[~over] for x in (sym, word, rank, at))
                continue
            rounds += 1
            if rounds > MAX_ROUNDS:
                rest = self._linked_rounds(sym, word, rank)
                done_sym.append(rest[0])
                done_word.append(rest[1])
                break
            place = np.flatnonzero(rank == np.repeat(best, count))
            same = word[place]
            fresh = np.concatenate([[True], same[1:] != same[:-1]])
            # Overlapping places (aaa): every other one from the left of each run.
            run = np.concatenate([[True], (place[1:] != place[:-1] + 1) | fresh[1:]])
            begin = np.maximum.accumulate(np.where(run, np.arange(len(place)), 0))
            place = place[np.where(self.alone[rank[place]], fresh, (np.arange(len(place)) - begin) % 2 == 0)]
            sym[place] = self.merged[at[place]]
            keep = np.ones(len(sym), bool)
            keep[place + 1] = False
            moved = np.cumsum(keep) - 1
            sym, word, rank, at = (x[keep] for x in (sym, word, rank, at))
            touched = moved[place]
            mark = np.zeros(len(sym) + 1, bool)
            mark[touched] = mark[touched - 1] = True  # a -1 is the spare place at the end
            touched = np.flatnonzero(mark[:-1])
            inside = touched[touched + 1 < len(sym)]
            rank[touched] = _NONE
            inside = inside[word[inside] == word[inside + 1]]
            rank[inside], at[inside] = self.look_up(sym[inside], sym[inside + 1])
        if not done_sym:
            return np.zeros(0, np.int32), np.zeros(len(chars) + 1, np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        sym, word = self._fall_back(sym, word)
        return sym.astype(np.int32), np.searchsorted(word, np.arange(len(chars) + 1))

    def _symbols(self) -> np.ndarray:
        """The symbol of each code point: its piece, or ``size`` plus itself."""
        if (table := self.__dict__.get("_symbol_table")) is None:
            table = self.size + np.arange(0x110000)
            for c, i in self.symbols.items():
                table[ord(c)] = i
            self._symbol_table = table
        return table

    def _pairs(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, at = np.full(len(sym), _NONE), np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            near = np.flatnonzero(word[1:] == word[:-1])
            rank[near], at[near] = self.look_up(sym[near], sym[near + 1])
        return rank, at

    def _fall_back(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte pieces for characters that are no pieces."""
        if not len(sym) or sym.max() < self.size:
            return sym, word
        c = sym - self.size
        n = np.where(c < 0, 1, 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))
        out = np.repeat(sym, n)
        j = np.arange(len(out)) - np.repeat(np.cumsum(n) - n, n)
        c, n_, raw = np.repeat(c, n), np.repeat(n, n), out >= self.size
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[n_]
        shift = 6 * (n_ - 1 - j)
        byte = np.where(n_ == 1, c, np.where(j == 0, lead | (np.maximum(c, 0) >> shift), 0x80 | (np.maximum(c, 0) >> shift) & 0x3F))
        out[raw] = self.byte_ids[byte[raw]]
        return out, np.repeat(word, n)

    def _linked_rounds(self, sym: np.ndarray, word: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merges of long words to their end, by rounds over linked symbols: each merges the leftmost places of the lowest rank."""
        n = len(sym)
        sym, after, before, alive = sym.copy(), np.arange(1, n + 1), np.arange(-1, n), np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def wait(place: np.ndarray, r: np.ndarray) -> None:
            if not len(r):
                return
            order = np.argsort(r, kind="stable")
            place, r = place[order], r[order]
            first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            for x, s, e in zip(r[first].tolist(), first.tolist(), np.append(first[1:], len(r)).tolist(), strict=True):
                if x not in waiting:
                    waiting[x] = []
                    heapq.heappush(ranks, x)
                waiting[x].append(place[s:e])

        start = np.flatnonzero(rank != _NONE)
        wait(start, rank[start])
        while ranks:
            r = heapq.heappop(ranks)
            found = waiting.pop(r)
            place = np.unique(np.concatenate(found)) if len(found) > 1 else np.sort(found[0])
            place = place[alive[place]]
            place = place[after[place] < n]
            place = place[word[place] == word[after[place]]]
            now, at = self.look_up(sym[place], sym[after[place]])
            place, at = place[now == r], at[now == r]  # the others have changed since they were noted
            if not len(place):
                continue
            same = word[place]
            fresh = np.concatenate([[True], same[1:] != same[:-1]])
            run = np.concatenate([[True], (place[1:] != after[place[:-1]]) | fresh[1:]])
            if self.alone[r]:
                pick = fresh
                wait(place[~pick], np.full(int((~pick).sum()), r))
            else:
                pick = (np.arange(len(place)) - np.maximum.accumulate(np.where(run, np.arange(len(place)), 0))) % 2 == 0
            place, at = place[pick], at[pick]
            gone = after[place]
            sym[place] = self.merged[at]
            alive[gone] = False
            after[place] = after[gone]
            before[after[place]] = place  # the last one's is the spare place at the end
            left = before[place]
            left = left[left >= 0]
            touched = np.unique(np.concatenate([left, place]))
            touched = touched[after[touched] < n]
            touched = touched[word[touched] == word[after[touched]]]
            new = self.look_up(sym[touched], sym[after[touched]])[0]
            wait(touched[new != _NONE], new[new != _NONE])
        return sym[alive], word[alive]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_symbol_table"}

    def decode_flat(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """A text for each id list; ``ends`` are where the lists end in ``ids``."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id is outside the vocabulary")
        begin, n = self.shown_at[ids], np.diff(self.shown_at)[ids]
        if self.prefix:  # the space of the first piece that shows
            shows = np.flatnonzero(self.kinds[ids] != CONTROL)
            heads = np.searchsorted(shows, np.concatenate([[0], ends[:-1]]))
            head = shows[heads[heads < len(shows)]] if len(shows) else shows
            head = np.unique(head)
            owner = np.searchsorted(ends, head, "right")
            head = head[np.concatenate([[True], owner[1:] != owner[:-1]])] if len(head) else head
            head = head[self.spaced[ids[head]]]
            begin[head] += 1
            n[head] -= 1
        total = np.concatenate([[0], np.cumsum(n)])
        raw = self.shown[np.arange(total[-1]) - np.repeat(total[:-1], n) + np.repeat(begin, n)].tobytes() if len(ids) else b""
        cuts = np.concatenate([[0], total[ends]]).tolist()
        return [self._text(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    @staticmethod
    def _text(raw: bytes) -> str:
        try:
            return raw.decode()
        except UnicodeDecodeError:
            out, i = [], 0
            while i < len(raw):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(raw[i : i + n].decode())
                        i += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    i += 1
            return "".join(out)


def load_model(path: str) -> BpeModel:
    """Read a SentencePiece model file on the driver."""
    with open(path, "rb") as f:
        return BpeModel(f.read())


class Encoder:
    """Encodes batches of texts, remembering the ids of up to ``MEMORY_WORDS`` words.

    Words are looked up by a 64-bit hash, and each is compared with the remembered bytes.
    """

    def __init__(self, model: BpeModel):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.begin, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.bytes, self.at, self.size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Encode these words; their slots."""
        total = np.cumsum(length) - length
        got = buf[np.repeat(start - total, length) + np.arange(length.sum())]
        code = np.frombuffer(got.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        chars = np.add.reduceat((got & 0xC0) != 0x80, total, dtype=np.int64)
        code[code == 32] = ord(SPACE)
        ids, cut = self.model.encode_words(code, chars)
        slots = len(self.count) + np.arange(len(length))
        self.begin = np.concatenate([self.begin, cut[:-1] + len(self.ids)])
        self.count = np.concatenate([self.count, np.diff(cut)])
        self.ids = np.concatenate([self.ids, ids])
        self.at = np.concatenate([self.at, total + len(self.bytes)])
        self.size = np.concatenate([self.size, length])
        self.bytes = np.concatenate([self.bytes, got])
        return slots

    def _mistaken(self, buf: np.ndarray, starts: np.ndarray, length: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Which words differ from the remembered word with their hash."""
        alike = self.size[slot] == length
        shift = np.where(alike, self.at[slot], 0) - starts
        same = self.bytes[np.minimum(np.repeat(shift, length) + np.arange(len(buf)), len(self.bytes) - 1)] == buf
        return np.flatnonzero(~(alike & np.logical_and.reduceat(same, starts)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array and the number of ids of each text. Null counts as empty."""
        offsets, raw = string_buffers(texts)
        if SPACE.encode() in raw[offsets[0] : offsets[-1]].tobytes():  # the sign itself means a space
            offsets, raw = string_buffers(pa.array([(t or "").replace(SPACE, " ") for t in texts.to_pylist()], pa.string()))
        buf, offsets = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
        full = np.diff(offsets) > 0
        if self.model.prefix:
            buf = np.insert(buf, offsets[:-1][full], 32)
            offsets = offsets + np.concatenate([[0], np.cumsum(full)])
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(full), np.int64)
        begins = np.zeros(len(buf), bool)
        if self.model.cuts:
            space = buf == 32
            begins[1:] = space[1:] & ~space[:-1]
        begins[offsets[:-1][full]] = True
        starts = np.flatnonzero(begins)
        length = np.diff(np.append(starts, len(buf)))
        words, first, back = np.unique(run_hashes(buf, length), return_index=True, return_inverse=True)
        if len(self.known) > MEMORY_WORDS:
            self._reset()
        at = np.minimum(np.searchsorted(self.known, words), max(len(self.known) - 1, 0))
        new = self.known[at] != words if len(self.known) else np.ones(len(words), bool)
        slot = np.zeros(len(words), np.int64)
        slot[~new] = self.slot[at[~new]]
        if new.any():
            slot[new] = self._learn(buf, starts[first[new]], length[first[new]])
            self.known, self.slot = np.concatenate([self.known, words[new]]), np.concatenate([self.slot, slot[new]])
            order = np.argsort(self.known)
            self.known, self.slot = self.known[order], self.slot[order]
        slot = slot[back.reshape(-1)]
        if len(wrong := self._mistaken(buf, starts, length, slot)):  # encoded apart, without a place under their hash
            slot[wrong] = self._learn(buf, starts[wrong], length[wrong])
        n = self.count[slot]
        total = np.concatenate([[0], np.cumsum(n)])
        flat = self.ids[np.arange(total[-1]) - np.repeat(total[:-1] - self.begin[slot], n)]
        return flat, np.diff(total[np.searchsorted(starts, offsets)])


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode(df: DataFrame, model: BpeModel, *, text: str = "text", out: str = "ids", bos: bool = False, eos: bool = False, decoded: str | None = None) -> DataFrame:
    """df and a column ``out``: the token ids (array<int>) that the library gives for the whole text.

    A null text counts as empty: it has only the ids asked for by bos and eos.
    With ``decoded``, a column of that name has what ``decode`` makes of the ids, in the same pass.
    All columns and repeated rows of df stay; df may have neither new column.
    Words of any length are merged to the end by rounds; an empty df gives no row.
    """
    if clash := {out, decoded} & set(df.columns):
        raise ValueError(f"input already has a column {', '.join(clash)}")
    source, names, own = with_text(df, text)
    head, tail = [model.bos] * bos, [model.eos] * eos

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for chunk in text_chunks(batches, own, CHUNK_BYTES):
            ids, n = encoder.encode(chunk.column(own))
            ends = np.cumsum(n)
            ids = np.insert(ids, np.repeat(ends - n, len(head)), np.tile(head, len(n)).astype(np.int32)) if head else ids
            n = n + len(head)
            ids = np.insert(ids, np.repeat(np.cumsum(n), len(tail)), np.tile(tail, len(n)).astype(np.int32)) if tail else ids
            n = n + len(tail)
            again = [pa.array(model.decode_flat(ids.astype(np.int64), np.cumsum(n)), pa.string())] * (decoded is not None)
            yield pa.RecordBatch.from_arrays([*(chunk.column(c) for c in names), _lists(ids, n), *again], names=[*names, "_ids", *(["_again"] * len(again))])

    schema = ", ".join([f"{c} {k}" for c, k in source.dtypes if c in names] + ["_ids array<int>"] + ["_again string"] * (decoded is not None))
    return map_arrow(source, run, schema).toDF(*df.columns, out, *([decoded] * (decoded is not None)))


def decode(df: DataFrame, model: BpeModel, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df and a column ``out``: the text of the token ids. Null or empty ids give an empty text; null ids inside are skipped."""
    if out in df.columns:
        raise ValueError(f"input already has a column {out}")
    names = [f"c{i}" for i in range(len(df.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, step = 0, 256
            while i < batch.num_rows:
                part = batch.slice(i, step)
                i += step
                lists = part.column("_ids")
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.diff(lists.offsets.to_numpy()).cumsum() if len(lists) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(model.decode_flat(flat, ends), pa.string())], names=[*names, "_text"])

    source = df.toDF(*names)
    source = source.withColumn("_ids", F.coalesce(F.filter(F.col(names[df.columns.index(ids)]).cast("array<int>"), lambda x: x.isNotNull()), F.array().cast("array<int>")))
    schema = ", ".join([f"{c} {k}" for c, k in source.drop("_ids").dtypes] + ["_text string"])
    return map_arrow(source, run, schema).toDF(*df.columns, out)
