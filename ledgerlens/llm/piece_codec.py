"""SentencePiece BPE encoding and decoding by vectorised merge rounds (operator 10).

Texts are cut into words, of which each distinct one is encoded once per slice. All distinct words lie in one flat symbol
array; a round looks up the rank of every adjacent pair, takes the smallest rank of each word (segmented minimum), merges
its leftmost non-overlapping occurrences at once, and compacts the array. Words without a pair left leave it. A word of more than
``LONG`` characters (text without spaces) would keep rounds going for itself alone; its pairs are merged in the same order
from a queue, in time nearly linear in its length.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlens.llm.common import clean_texts, ragged, slices, string_from, string_parts

SPACE = "▁"
NO_RANK = np.int32(2**31 - 1)
#: Words of more symbols are merged one pair at a time.
LONG = 128
GONE = -(1 << 31)


class PairTable:
    """Pairs of symbols to the piece they merge into: levels of direct-mapped tables, a collision goes one level down."""

    MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)

    def __init__(self, levels: list[tuple]):
        self.levels = levels

    @classmethod
    def built(cls, keys: np.ndarray, values: np.ndarray) -> PairTable:
        levels = []
        while len(keys):
            bits = max(4, int(np.ceil(np.log2(len(keys)))) + 3)
            factor = np.uint64(cls.MULTIPLIERS[len(levels) % 4])
            slots = cls._slots(keys, factor, bits)
            _, first = np.unique(slots, return_index=True)
            table, result = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
            table[slots[first]], result[slots[first]] = keys[first], values[first]
            levels.append((factor, bits, table, result))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values = keys[rest], values[rest]
        return cls(levels)

    @staticmethod
    def _slots(keys: np.ndarray, factor: np.uint64, bits: int) -> np.ndarray:
        return ((keys * factor) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The merged piece of each pair, -1 where there is none."""
        found = np.full(len(keys), -1, np.int32)
        for factor, bits, table, result in self.levels:
            slots = self._slots(keys, factor, bits)
            found = np.where(table[slots] == keys, result[slots], found)
        return found


class PieceCodec:
    """Encoder and decoder for one BPE model with byte fallback, identity normalisation and a dummy prefix.

    ``tables`` are plain values and arrays (about 10 MB, fixed by the vocabulary), so they can be broadcast.
    """

    def __init__(self, tables: dict):
        self.tables = tables
        self.__dict__.update(tables)
        self.pairs = PairTable(tables["levels"])
        self._known: dict[int, int] | None = None

    @classmethod
    def of_model(cls, path: str) -> PieceCodec:
        return cls(_model_tables(path))

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the offsets of each word's ids."""
        data, at = string_parts(words)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int32)
        before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        lengths = np.diff(before[at])
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        symbol = self.char_symbol[points]
        symbol = np.where(symbol < 0, -1 - points, symbol)
        done_word, done_symbol = [], []
        long = np.flatnonzero(lengths > LONG)
        for w in long.tolist():
            first = int(before[at[w]])
            merged = self._queued(symbol[first : first + int(lengths[w])].tolist())
            done_word.append(np.full(len(merged), w, np.int32))
            done_symbol.append(np.array(merged, symbol.dtype))
        if len(long):
            short = np.repeat(lengths <= LONG, lengths)
            symbol, word = symbol[short], word[short]
        while len(symbol):
            left, right = symbol[:-1], symbol[1:]
            near = (word[:-1] == word[1:]) & (left >= 0) & (right >= 0)
            merged = np.full(len(symbol), -1, np.int32)
            at_pair = np.flatnonzero(near)
            merged[at_pair] = self.pairs.find((left[at_pair].astype(np.uint64) << np.uint64(32)) | right[at_pair].astype(np.uint64))
            rank = np.where(merged >= 0, self.rank[merged], NO_RANK)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(first, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, first), size)
            open_ = least < NO_RANK
            done_word.append(word[~open_])
            done_symbol.append(symbol[~open_])
            chosen = open_ & (rank == least)
            spot = np.flatnonzero(chosen)
            if not len(spot):
                break
            # In a run of adjacent occurrences every other one is merged, from the left.
            run = np.concatenate([[True], (spot[1:] != spot[:-1] + 1)])
            place = np.arange(len(spot)) - np.maximum.accumulate(np.where(run, np.arange(len(spot)), 0))
            owner = word[spot]
            head = np.concatenate([[True], owner[1:] != owner[:-1]])
            spot = spot[(place % 2 == 0) & (head | ~self.single[merged[spot]])]
            symbol[spot] = merged[spot]
            keep = open_
            keep[spot + 1] = False
            symbol, word = symbol[keep], word[keep]
        word, symbol = np.concatenate(done_word or [word]), np.concatenate(done_symbol or [symbol])
        order = np.argsort(word, kind="stable")
        word, symbol = word[order], symbol[order]
        return self._with_bytes(word, symbol, len(words))

    def _queued(self, symbol: list[int]) -> list[int]:
        """The same merges for one very long word, which would need about as many rounds as merges: pairs wait in a queue by
        rank, then place, as a round would take them."""
        if self._known is None:
            self._known = {}
            for _, _, keys, values in self.pairs.levels:
                used = values >= 0  # most slots are empty
                self._known.update(zip(keys[used].tolist(), values[used].tolist(), strict=True))
        known, rank = self._known, self.rank
        after, before = [*range(1, len(symbol)), -1], [*range(-1, len(symbol) - 1)]

        def pair(i: int, j: int) -> tuple | None:
            merged = known.get((symbol[i] << 32) | symbol[j]) if symbol[i] >= 0 and symbol[j] >= 0 else None
            return None if merged is None else (int(rank[merged]), i, j, symbol[i], symbol[j], merged)

        queue = [p for p in (pair(i, i + 1) for i in range(len(symbol) - 1)) if p]
        heapq.heapify(queue)
        while queue:
            _, i, j, left, right, merged = heapq.heappop(queue)
            if symbol[i] != left or symbol[j] != right or after[i] != j:
                continue
            symbol[i], symbol[j] = merged, GONE
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                found = pair(a, b) if a >= 0 and b >= 0 else None
                if found:
                    heapq.heappush(queue, found)
        return [s for s in symbol if s != GONE]

    def _with_bytes(self, word: np.ndarray, symbol: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Spell symbols outside the vocabulary by their UTF-8 bytes."""
        odd = np.flatnonzero((symbol < 0) | (symbol >= self.size))
        counts = np.ones(len(symbol), np.int64)
        if len(odd):
            spelled = [chr(self.extra_char[s] if s >= 0 else -1 - s).encode() for s in symbol[odd].tolist()]
            counts[odd] = [len(s) for s in spelled]
            start = np.cumsum(counts) - counts
            ids = np.repeat(symbol, counts)
            ids[ragged(start[odd], counts[odd])] = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        else:
            ids = symbol
        per_word = np.bincount(word, weights=counts, minlength=n).astype(np.int64) if len(word) else np.zeros(n, np.int64)
        return ids.astype(np.int32), np.concatenate([[0], np.cumsum(per_word)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of null-free texts with begin and end ids, and the offsets of each text's ids."""
        data, at = string_parts(texts)
        sizes = np.diff(at)
        if len(data) and (data == 0xE2).any() and SPACE.encode() in data.tobytes():
            import pyarrow.compute as pc

            data, at = string_parts(pc.replace_substring(texts, SPACE, " "))
            sizes = np.diff(at)
        some = sizes > 0
        data = np.insert(data, at[:-1][some], 0x20)  # the dummy prefix
        at = np.concatenate([[0], np.cumsum(sizes + some)])
        blank = data == 0x20
        cut = blank.copy()
        cut[1:] &= ~blank[:-1]
        if self.newline_apart:
            line = data == 0x0A
            cut |= line
            cut[1:] |= line[:-1]
        cut[at[:-1][some]] = True
        starts = np.flatnonzero(cut)
        coded = string_from(data, np.append(starts, len(data))).dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        ids, id_at = self.encode_words(coded.dictionary)
        lengths = np.diff(id_at)[index]
        total = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(starts, at)]
        flat = ids[ragged(id_at[:-1][index], lengths)]
        n = len(sizes)
        out = np.empty(len(flat) + 2 * n, np.int32)
        out_at = total + 2 * np.arange(n + 1)
        body = np.ones(len(out), bool)
        body[out_at[:-1]] = body[out_at[1:] - 1] = False
        out[out_at[:-1]], out[out_at[1:] - 1], out[body] = self.bos, self.eos, flat
        return out, out_at

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """UTF-8 text of each row of ids, without the dummy prefix; a byte that fits no character becomes U+FFFD."""
        lengths = np.diff(self.spelled_at)[ids]
        data = self.spelled[ragged(self.spelled_at[:-1][ids], lengths)].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[at]
        out = []
        for i in range(len(at) - 1):
            text = data[ends[i] : ends[i + 1]]
            try:
                text.decode()
            except UnicodeDecodeError:
                text = self._mended(ids[at[i] : at[i + 1]])
            out.append(text[1:] if text[:1] == b" " and not self._opens_unknown(ids[at[i] : at[i + 1]]) else text)
        return out

    def _opens_unknown(self, ids: np.ndarray) -> bool:
        rest = ids[(ids != self.bos) & (ids != self.eos)]
        return bool(len(rest)) and rest[0] in (self.unknown, self.byte_ids[0x20])

    def _mended(self, ids: np.ndarray) -> bytes:
        out, run = [], b""
        for i in [*ids.tolist(), None]:
            if i is not None and self.is_byte[i]:
                run += self.spelled[self.spelled_at[i] : self.spelled_at[i + 1]].tobytes()
                continue
            while run:
                size = next((k for k in (1, 2, 3, 4) if len(run) >= k and _is_text(run[:k])), 0)
                out.append(run[:size] if size else "�".encode())
                run = run[size or 1 :]
            if i is not None:
                out.append(self.spelled[self.spelled_at[i] : self.spelled_at[i + 1]].tobytes())
        return b"".join(out)


def _is_text(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def _model_tables(path: str) -> dict:
    """Symbols, merges, ranks and spellings of a model, read through the library's own accessors."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    if sp.encode("  a ") == sp.encode("a") or any(map(sp.is_unused, range(size))):
        raise ValueError("only models that keep white space and have no unused pieces are supported")
    pieces = [sp.id_to_piece(i) for i in range(size)]
    special = {i for i in range(size) if sp.is_control(i) or sp.is_unknown(i)}
    byte_ids = np.full(256, -1, np.int32)
    is_byte = np.zeros(size, bool)
    for i in range(size):
        if sp.is_byte(i):
            byte_ids[int(pieces[i][3:5], 16)] = i
            is_byte[i] = True
    if (byte_ids < 0).any():
        raise ValueError("only models with byte fallback are supported")
    normal = {pieces[i]: i for i in range(size) if i not in special and not is_byte[i]}
    if any(SPACE in p.lstrip(SPACE) for p in normal):
        raise ValueError("only models whose pieces hold a space at their start alone are supported")

    # Characters inside pieces that are no piece themselves get symbols of their own, past the vocabulary.
    symbols = dict(normal)
    for c in sorted({c for p in normal for c in p} - set(normal)):
        symbols[c] = size + len(symbols) - len(normal)
    char_symbol = np.full(0x110000, -1, np.int32)
    extra_char = {}
    joined = set()
    for p in normal:
        joined.update(p if len(p) > 1 else ())
    for text, i in symbols.items():
        if len(text) == 1:
            char_symbol[ord(text)] = i
            if i >= size:
                extra_char[i] = ord(text)
    char_symbol[0x20] = char_symbol[0x2581]

    scores = np.array([sp.get_score(i) for i in range(size)])
    levels, rank = np.unique(-scores, return_inverse=True)
    count = np.zeros(len(levels), np.int64)
    np.add.at(count, rank[list(normal.values())], 1)
    keys, values = [], []
    single = np.zeros(size, bool)  # pieces that only one occurrence at a time may be merged into
    single[count[rank] > 1] = True
    for text, i in normal.items():
        for k in range(1, len(text)):
            left, right = symbols.get(text[:k]), symbols.get(text[k:])
            if left is not None and right is not None:
                keys.append((left << 32) | right)
                values.append(i)
                for part in (left, right):
                    if part < size and rank[i] <= rank[part]:
                        single[part] = True
    pairs = PairTable.built(np.array(keys, np.uint64), np.array(values, np.int32))

    spelled = [b"" if i in special else bytes([int(p[3:5], 16)]) if is_byte[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
    if sp.unk_id() >= 0:
        spelled[sp.unk_id()] = " ⁇ ".encode()
    return {
        "size": size, "bos": sp.bos_id(), "eos": sp.eos_id(), "unknown": sp.unk_id(), "byte_ids": byte_ids, "is_byte": is_byte,
        "char_symbol": char_symbol, "extra_char": extra_char, "newline_apart": "\n" not in joined, "levels": pairs.levels,
        "rank": rank.astype(np.int32), "single": single, "spelled": np.frombuffer(b"".join(spelled), np.uint8),
        "spelled_at": np.concatenate([[0], np.cumsum([len(s) for s in spelled])]).astype(np.int64),
    }


def encode_documents(docs: DataFrame, model: str, keep_ids: bool = True, keep_text: bool = True) -> DataFrame:
    """Ids of every whole text, and digests of the ids and of the text decoded from them.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not looked at. A null text counts as empty and gives the
    begin and end ids alone. Repeated rows are encoded each for itself; an empty table gives an empty result.
    ``model`` is a path on the driver; the tables made from it are broadcast. Returns doc_id, n_tokens, ids_sha256 (little-endian unsigned 32-bit
    ids), decoded_sha256 (UTF-8), with ``keep_ids`` the ids, and with ``keep_text`` the decoded text. No shuffle; memory is bounded
    by slices of 2 MB or one text.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text

    tables = docs.sparkSession.sparkContext.broadcast(_model_tables(model))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PieceCodec(tables.value)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                ids, at = own.encode(part.column("text"))
                decoded = own.decode(ids, at)
                raw = ids.astype("<u4").tobytes()
                columns = [
                    part.column("doc_id"),
                    pa.array(np.diff(at)),
                    pa.array([hashlib.sha256(raw[4 * at[i] : 4 * at[i + 1]]).hexdigest() for i in range(len(at) - 1)], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)))
                    names.append("ids")
                if keep_text:
                    columns.append(pa.array(decoded, pa.binary()).cast(pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return clean_texts(docs).mapInArrow(encode, schema)
