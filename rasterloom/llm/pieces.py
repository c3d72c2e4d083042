"""SentencePiece encoding and decoding by suffix-array matching."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Bytes of text that are indexed together; bounds a worker's memory, but for single longer texts.
BATCH_BYTES = 2_000_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, struct.unpack("<f" if n == 4 else "<d", data[at : at + n])[0]
            at += n


class Vocabulary:
    """Pieces of a BPE model, ranked by when BPE makes them, with their last merges.

    Ranks: the single characters first, then the others by falling score. ``left`` and
    ``right`` hold a piece's last merge (itself for a single character); ``pair_codes`` has
    all pairs of pieces whose concatenation is a piece. Runs of spaces share one score in
    these models, so they are left out here and put together after the merges.
    """

    def __init__(self, model: bytes) -> None:
        pieces, kind, dummy, extra, charsmap = [], 1, True, True, b""
        for number, value in _fields(model):
            if number == 1:
                p = dict(_fields(value))
                pieces.append((p.get(1, b"").decode(), p.get(2, 0.0), p.get(3, NORMAL)))
            elif number == 2:
                kind = dict(_fields(value)).get(3, 1)
            elif number == 3:
                spec = dict(_fields(value))
                dummy, extra, charsmap = spec.get(3, 1), spec.get(4, 1), spec.get(2, b"")
        if kind != 2 or extra or charsmap:
            raise ValueError("only BPE models that leave the text as it is are supported")
        self.dummy = bool(dummy)
        if any(t == USER for _, _, t in pieces):
            raise ValueError("user-defined pieces are not supported")
        self.unk = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
        self.bytes = np.full(256, self.unk, np.int32)
        for i, (text, _, t) in enumerate(pieces):
            if t == BYTE:
                self.bytes[int(text[3:5], 16)] = i
        ids = {text: i for i, (text, _, t) in enumerate(pieces) if t == NORMAL}
        self.runs = {len(text): i for text, i in ids.items() if set(text) == {SPACE}}
        inner = {text: i for text, i in ids.items() if len(text) == 1 or set(text) != {SPACE}}
        order = sorted(inner, key=lambda x: (len(x) > 1, -pieces[inner[x]][1] if len(x) > 1 else 0, inner[x]))
        scores = [pieces[inner[x]][1] for x in order if len(x) > 1]
        if len(set(scores)) != len(scores):
            raise ValueError("pieces with equal scores are not supported")
        rank = {x: i for i, x in enumerate(order)}
        n = self.n = len(order)
        pairs: dict[int, int] = {}
        for text, r in rank.items():
            for cut in range(1, len(text)):
                a, b = rank.get(text[:cut]), rank.get(text[cut:])
                if a is not None and b is not None:
                    pairs[a * n + b] = r
        self.left, self.right = np.arange(n), np.arange(n)
        made = np.ones(n, bool)
        for text, r in rank.items():
            if len(text) > 1:
                parts = [rank.get(c, -1) for c in text]
                while len(parts) > 2:
                    best = min(((pairs.get(a * n + b, n) if a >= 0 <= b else n), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                    if best[0] == n:
                        break
                    parts[best[1] : best[1] + 2] = [best[0]]
                made[r] = len(parts) == 2 and pairs.get(parts[0] * n + parts[1]) == r
                if made[r]:
                    self.left[r], self.right[r] = parts
        self.pair_codes = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[c] for c in self.pair_codes.tolist()], np.int64)
        self.ids = np.array([inner[x] for x in order], np.int32)
        self.texts = [x.encode() for x in order]
        self.made = made
        # units end before a space and around a line end, if no piece goes over that
        self.cut = not any(SPACE in x.lstrip(SPACE) or ("\n" in x and len(x) > 1) for x in order)
        self.singles = {x for x in order if len(x) == 1}
        table = [b"" if t in (CONTROL, UNKNOWN) else bytes([int(text[3:5], 16)]) if t == BYTE else text.replace(SPACE, " ").encode() for text, _, t in pieces]
        self.out_len = np.array([len(x) for x in table], np.int64)
        self.out_off = np.concatenate([[0], np.cumsum(self.out_len)])[:-1]
        self.out = np.frombuffer(b"".join(table), np.uint8)
        # pieces of up to 8 bytes as ranges of their first 8 bytes; longer ones by those
        self.short = np.array([i for i, x in enumerate(self.texts) if made[i] and len(x) <= 8], np.int64)
        value = np.array([int.from_bytes(self.texts[i], "big") for i in self.short], np.uint64)
        pad = np.array([8 * (8 - len(self.texts[i])) for i in self.short], np.uint64)
        self.short_low, self.short_high = value << pad, (value << pad) | ((np.uint64(1) << pad) - np.uint64(1))
        self.long = sorted((x, i) for i, x in enumerate(self.texts) if made[i] and len(x) > 8)

    def joined(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether BPE keeps two neighbouring pieces apart.

        Undoes the later merge of both sides in turn; if the two pieces at the seam would
        have been merged earlier than the merge that was undone, BPE would not have stopped
        with this pair.
        """
        t1, t2 = first.copy(), second.copy()
        limit = np.full(len(t1), 1 << 40, np.int64)
        result, live = np.ones(len(t1), bool), np.arange(len(t1))
        while len(live):
            code = t1 * self.n + t2
            at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
            bad = (self.pair_codes[at] == code) & (self.pair_ranks[at] < limit)
            result[live[bad]] = False
            later = t1 > t2
            a, b = np.where(later, self.right[t1], t1), np.where(later, t2, self.left[t2])
            lim = np.where(later, t1, t2 + 1)
            stuck = np.where(later, a == t1, b == t2)  # a single character: undo the other side
            other_a, other_b = np.where(stuck & ~later, self.right[t1], a), np.where(stuck & later, self.left[t2], b)
            lim = np.where(stuck, np.where(later, t2 + 1, t1), lim)
            done = stuck & np.where(later, other_b == t2, other_a == t1)
            keep = ~bad & ~done
            live, t1, t2, limit = live[keep], other_a[keep], other_b[keep], lim[keep]
        return result

    def matches(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (place, piece rank) where a piece occurs, by binary search in the suffix array.

        Suffixes are sorted by their first 8 bytes; the ranges that longer pieces ask for are
        sorted further, by 8 bytes at a time.
        """
        n = len(data)
        padded = np.concatenate([data, np.zeros(64, np.uint8)])

        def key(at: np.ndarray) -> np.ndarray:
            out = np.zeros(len(at), np.uint64)
            for i in range(8):
                out = (out << np.uint64(8)) | padded[np.minimum(at + i, n + 63)]
            return out

        words = np.zeros(n, np.uint64)
        for i in range(8):
            words = (words << np.uint64(8)) | padded[i : i + n]
        suffixes = np.argsort(words, kind="stable").astype(np.int32)
        words = words[suffixes]
        low, high = np.searchsorted(words, self.short_low), np.searchsorted(words, self.short_high, side="right")
        count = high - low
        places, ranks = [suffixes[_ranges(low, count)]], [np.repeat(self.short, count).astype(np.int32)]

        def deeper(group: list[tuple[bytes, int]], lo: int, hi: int, depth: int) -> None:
            """The pieces of a group share their first ``depth`` bytes, as suffixes lo..hi do."""
            part = suffixes[lo:hi]
            keys = key(part.astype(np.int64) + depth)
            order = np.argsort(keys, kind="stable")
            suffixes[lo:hi], keys = part[order], keys[order]
            heads: dict[bytes, list[tuple[bytes, int]]] = {}
            for text, r in group:
                rest = text[depth : depth + 8]
                if len(text) <= depth + 8:
                    pad = 8 * (8 - len(rest))
                    at = int.from_bytes(rest, "big") << pad
                    a, b = np.searchsorted(keys, np.uint64(at)), np.searchsorted(keys, np.uint64(at | ((1 << pad) - 1)), side="right")
                    if b > a:
                        places.append(suffixes[lo + a : lo + b].copy())
                        ranks.append(np.full(b - a, r, np.int32))
                else:
                    heads.setdefault(rest, []).append((text, r))
            for head, more in heads.items():
                at = np.uint64(int.from_bytes(head, "big"))
                a, b = np.searchsorted(keys, at), np.searchsorted(keys, at, side="right")
                if b > a:
                    deeper(more, lo + a, lo + b, depth + 8)

        heads: dict[bytes, list[tuple[bytes, int]]] = {}
        for text, r in self.long:
            heads.setdefault(text[:8], []).append((text, r))
        firsts = np.array([int.from_bytes(h, "big") for h in heads], np.uint64)
        for group, a, b in zip(heads.values(), np.searchsorted(words, firsts), np.searchsorted(words, firsts, side="right"), strict=True):
            if b > a:
                deeper(group, int(a), int(b), 8)
        return np.concatenate(places), np.concatenate(ranks)

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all units one after another, and where each unit's begin.

        Edges (matches) are sorted by their ends and relaxed in that order, all units at a
        time: the prefix up to an edge's end is encoded with the edge's piece last if the
        piece and the last piece of the prefix up to its start can stand side by side. For
        each end this holds for one edge.
        """
        raw = [u.encode() for u in units]
        length = np.array([len(x) for x in raw], np.int64)
        begin = np.concatenate([[0], np.cumsum(length + 1)])
        data = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
        n = len(data)
        place, piece = self.matches(data)
        size = np.array([len(x) for x in self.texts], np.int32)
        # characters that are no piece are edges of their own, with bytes as tokens; nothing merges over them
        lead = (data & 0xC0) != 0x80
        lead[begin[1:] - 1] = False
        single = np.zeros(n, bool)
        ends = place + size[piece]
        wide = np.flatnonzero(lead)
        char = np.zeros(n, np.int32)
        char[wide] = np.where(data[wide] < 0x80, 1, np.where(data[wide] < 0xE0, 2, np.where(data[wide] < 0xF0, 3, 4)))
        single[place[size[piece] == char[place]]] = True
        lost = wide[~single[wide]]
        place = np.concatenate([place, lost.astype(np.int32)])
        piece = np.concatenate([piece, np.full(len(lost), -1, np.int32)])
        ends = np.concatenate([ends, (lost + char[lost]).astype(np.int32)])
        unit_begin = np.repeat(begin[:-1], length + 1).astype(np.int32)
        relative = ends - unit_begin[place]
        if len(relative) and relative.max() < 1 << 16:
            relative = relative.astype(np.uint16)  # sorted by radix
        order = np.argsort(relative, kind="stable")
        place, piece, ends, relative = place[order], piece[order], ends[order], relative[order]
        steps = np.concatenate([[0], np.flatnonzero(np.diff(relative)) + 1, [len(relative)]]) if len(relative) else np.zeros(1, np.int64)
        last, since = np.full(n + 1, -2, np.int32), np.full(n + 1, -1, np.int32)  # -2: no prefix ends here, -1: a lost character
        first = np.zeros(n + 1, bool)
        first[begin[:-1]] = True
        for lo, hi in zip(steps[:-1], steps[1:], strict=True):
            p, t, e = place[lo:hi], piece[lo:hi], ends[lo:hi]
            before = last[p]
            good = first[p] | (before == -1) | ((t == -1) & (before != -2))
            ask = np.flatnonzero(~good & (before >= 0) & (t >= 0))
            if len(ask):
                code, back = np.unique(before[ask].astype(np.int64) * self.n + t[ask], return_inverse=True)
                good[ask] = self.joined(code // self.n, code % self.n)[back]
            last[e[good]], since[e[good]] = t[good], p[good]
        # walk back from the units' ends, all units at a time
        at, owner = begin[1:] - 1, np.arange(len(units))
        starts, owners = [], []
        while len(at):
            more = at > begin[owner]
            at, owner = at[more], owner[more]
            if not len(at):
                break
            starts.append(at)
            owners.append(owner)
            at = since[at].astype(np.int64)
        end = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        own = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(end, kind="stable")
        end, own = end[order], own[order]
        token, start = last[end], since[end].astype(np.int64)
        width = np.where(token >= 0, 1, end - start)
        out = np.repeat(np.where(token >= 0, self.ids[np.maximum(token, 0)], 0), width).astype(np.int32)
        gone = np.repeat(token < 0, width)
        if gone.any():
            out[gone] = self.bytes[data[_ranges(start, width)][gone]]
        counts = np.bincount(own, weights=width, minlength=len(units)).astype(np.int64)
        return out, np.concatenate([[0], np.cumsum(counts)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, and where each text's begin."""
        index: dict[str, int] = {}
        flat: list[int] = []
        lengths = []
        find = re.compile(f"{SPACE}?[^{SPACE}\n]+|{SPACE}|\n").findall
        for text in texts:
            whole = (SPACE if self.dummy else "") + text.replace(" ", SPACE) if text else ""
            units = find(whole) if self.cut else [whole] if whole else []
            flat += [index.setdefault(u, len(index)) for u in units]
            lengths.append(len(units))
        if not flat:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        tokens, offsets = self.encode_units(list(index))
        use = np.array(flat, np.int64)
        count = (offsets[1:] - offsets[:-1])[use]
        out = tokens[_ranges(offsets[use], count)]
        unit_at = np.concatenate([[0], np.cumsum(count)])
        text_at = unit_at[np.concatenate([[0], np.cumsum(lengths)])]
        return self._space_runs(out, text_at)

    def _space_runs(self, tokens: np.ndarray, text_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Puts neighbouring single spaces together, from the left, as far as there are pieces for it."""
        most, space = max(self.runs), self.runs.get(1, -1)
        is_space = tokens == space
        if not (is_space[1:] & is_space[:-1]).any():
            return tokens, text_at
        out, at = [], [0]
        for a, b in zip(text_at[:-1], text_at[1:], strict=True):
            part = tokens[a:b]
            own = part == space
            if (own[1:] & own[:-1]).any():
                edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                parts, done = [], 0
                for lo, hi in zip(edge[::2], edge[1::2], strict=True):
                    parts.append(part[done:lo])
                    run = hi - lo
                    while run:
                        take = next(k for k in range(min(run, most), 0, -1) if k in self.runs)
                        parts.append(np.array([self.runs[take]], np.int32))
                        run -= take
                    done = hi
                part = np.concatenate([*parts, part[done:]])
            out.append(part)
            at.append(at[-1] + len(part))
        return np.concatenate(out), np.array(at, np.int64)

    def decode(self, tokens: np.ndarray) -> str:
        """The text of token ids; bytes that are no UTF-8 become U+FFFD."""
        raw = self.out[_ranges(self.out_off[tokens], self.out_len[tokens])].tobytes().decode("utf-8", "replace")
        return raw[1:] if self.dummy and raw[:1] == " " else raw


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + count[0] - 1, start[1] .. and so on."""
    total = int(count.sum())
    out = np.ones(total, np.int64)
    some = count > 0
    start, count = np.asarray(start, np.int64)[some], count[some]
    if total:
        out[0] = start[0]
        out[np.cumsum(count)[:-1]] = start[1:] - (start[:-1] + count[:-1] - 1)
    return np.cumsum(out)


_loaded: dict[int, Vocabulary] = {}


def vocabulary(model: bytes) -> Vocabulary:
    """Built once in each Python worker."""
    at = hash(model)
    if at not in _loaded:
        _loaded[at] = Vocabulary(model)
    return _loaded[at]


def encode_documents(documents: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each whole text's tokens: doc_id, n_tokens, tokens, round_trip.

    The tokens are those of the sentencepiece library. round_trip tells whether decoding them
    gives the text again (U+2581 stands for a space in this format, and comes back as one).
    Null and empty texts have no tokens. The driver reads the model file; its bytes (under
    1 MB) go to the workers. Distinct words of a batch are indexed together, so repeated
    rows and words cost one search. An empty table gives an empty one. Other columns are not
    read.
    """
    bounded_batches(documents.sparkSession)
    with open(model_path, "rb") as f:
        model = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model.value)
        give_back()  # what earlier stages left in this worker
        for batch in batches:
            ids, column, at = batch.column(0), batch.column(1), 0
            upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            while at < len(column):
                before = int(upto[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(upto, before + BATCH_BYTES, side="right")))
                part = [x or "" for x in column.slice(at, to - at).to_pylist()]
                tokens, off = v.encode(part)
                same = [v.decode(tokens[a:b]) == x.replace(SPACE, " ") for x, a, b in zip(part, off[:-1], off[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(tokens))
                yield pa.record_batch([ids.slice(at, to - at), pa.array(np.diff(off), pa.int64()), lists, pa.array(same)], names=["doc_id", "n_tokens", "tokens", "round_trip"])
                at = to
                del part, tokens, off, same, lists
                give_back()

    return documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint, tokens array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """doc_id and text of token lists; a null list gives a null text, an empty table an empty one, repeated rows repeated ones."""
    bounded_batches(encoded.sparkSession)
    with open(model_path, "rb") as f:
        model = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model.value)
        for batch in batches:
            texts = [None if x is None else v.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(tokens_col).alias("tokens")).mapInArrow(run, "doc_id bigint, text string")
