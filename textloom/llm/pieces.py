"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie."""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import buffers
from .workspace import fresh, q, small_batches, typed

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MARK = "▁"
UNK_PENALTY = 10.0
CACHE = 200_000
VECTOR_BYTES = 96


def _varint(b: bytes, i: int) -> tuple[int, int]:
    r = s = 0
    while True:
        c = b[i]
        i += 1
        r |= (c & 127) << s
        s += 7
        if c < 128:
            return r, i


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            v, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            v, i = b[i : i + n], i + n
        yield key >> 3, v


def double_array(keys: list[bytes], values: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value) of a trie over bytes: the child of node s by byte c is t = base[s] + c + 1 if check[t] = s;
    value[t] is the key's value or -1. Node 0 is the root. Keys must be distinct and not empty."""
    order = sorted(range(len(keys)), key=lambda i: keys[i])
    keys = [keys[i] for i in order]
    size = 1 << 12
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    used = np.zeros(size, bool)
    used[0] = True
    check[0] = -2
    todo = [(0, 0, len(keys), 0)]
    hint, top = 1, 1

    def grow() -> None:
        nonlocal size, base, check, value, used
        base, check, value = (np.concatenate([x, np.full(size, f, np.int32)]) for x, f in ((base, 0), (check, -1), (value, -1)))
        used = np.concatenate([used, np.zeros(size, bool)])
        size *= 2

    while todo:
        node, lo, hi, depth = todo.pop()
        if lo < hi and len(keys[lo]) == depth:
            value[node] = values[order[lo]]
            lo += 1
        if lo == hi:
            continue
        kids: list[tuple[int, int, int]] = []
        i = lo
        while i < hi:
            c, j = keys[i][depth], i
            while j < hi and keys[j][depth] == c:
                j += 1
            kids.append((c + 1, i, j))
            i = j
        codes = np.array([k[0] for k in kids])
        if len(kids) == 1:  # any free slot does
            while used[hint] or hint < codes[0]:
                hint += 1
                if hint + 600 > size:
                    grow()
            at = hint - int(codes[0])
        else:
            at = max(0, top - 1024)
            while True:
                while at + 800 > size:
                    grow()
                taken = np.zeros(512, bool)
                for c in codes.tolist():
                    taken |= used[at + c : at + c + 512]
                free = np.flatnonzero(~taken)
                if len(free):
                    at += int(free[0])
                    break
                at += 512
            top = max(top, at + int(codes[-1]))
        base[node] = at
        used[at + codes] = True
        check[at + codes] = node
        todo.extend((at + c, a, b, depth + 1) for c, a, b in kids)
    last = int(np.flatnonzero(used)[-1]) + 258
    pad = max(0, last - size)
    return np.pad(base, (0, pad))[:last], np.pad(check, (0, pad), constant_values=-1)[:last], np.pad(value, (0, pad), constant_values=-1)[:last]


class PieceModel:
    """A SentencePiece model file read as a unigram model.

    A file of unigram type brings its log scores. One of BPE type brings ranks instead; piece r of n then gets the
    log probability of Zipf's law, -log(r + 1) - log(H_n). Text is normalised as the file says: by its table of characters (as NFKC), and
    by dropping outer blanks and squeezing others. Then blanks become U+2581, and one is put before the text if the file says so."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            raw = f.read()
        self.pieces: list[str] = []
        scores: list[float] = []
        self.kinds: list[int] = []
        self.prefix, self.kind, self.squeeze, self.units, self.forms = True, 1, True, None, b""
        for key, v in _fields(raw):
            if key == 1:
                d = {1: b"", 2: struct.pack("<f", 0), 3: NORMAL} | dict(_fields(v))
                self.pieces.append(d[1].decode())
                scores.append(struct.unpack("<f", d[2])[0])
                self.kinds.append(d[3])
            elif key == 2:
                self.kind = dict(_fields(v)).get(3, 1)
            elif key == 3:
                d = dict(_fields(v))
                if d.get(2):
                    size = struct.unpack("<I", d[2][:4])[0]
                    self.units, self.forms = np.frombuffer(d[2][4 : 4 + size], "<u4").tolist(), bytes(d[2][4 + size :])
                self.prefix, self.squeeze = bool(d.get(3, 1)), bool(d.get(4, 1))
        kinds = np.array(self.kinds)
        self.scores = np.array(scores, np.float64)
        if self.kind != 1:
            normal = np.flatnonzero(kinds == NORMAL)
            rank = np.empty(len(normal), np.int64)
            rank[np.argsort(-self.scores[normal], kind="stable")] = np.arange(len(normal))
            self.scores = np.zeros(len(kinds))
            self.scores[normal] = -np.log(rank + 1.0) - math.log(float((1.0 / np.arange(1, len(normal) + 1)).sum()))
        self.unk = int(np.flatnonzero(kinds == UNKNOWN)[0])
        self.bytes = np.full(256, -1, np.int32)
        for i in np.flatnonzero(kinds == BYTE).tolist():
            self.bytes[int(self.pieces[i][1:-1], 16)] = i
        self.fallback = bool((self.bytes >= 0).all())
        self.unk_score = float(self.scores[kinds == NORMAL].min()) - UNK_PENALTY
        inside = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER) and self.pieces[i]]
        self.base, self.check, self.value = double_array([self.pieces[i].encode() for i in inside], inside)
        self.crossing = any(re.search(f"[^{MARK}]{MARK}|.\n|\n.", self.pieces[i]) for i in inside)
        pool = [bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, self.kinds)]
        self.length = np.array([len(p) for p in pool], np.int64)
        self.at = np.cumsum(self.length) - self.length
        self.pool = np.frombuffer(b"".join(pool), np.uint8)
        self.cache: dict[str, bytes] = {}
        fixed = sorted((p.encode() for p, k in zip(self.pieces, self.kinds) if k == USER and p), key=len, reverse=True)
        self.user = re.compile(b"|".join(map(re.escape, fixed))) if fixed else None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    # normalising

    @property
    def identity(self) -> bool:
        return self.units is None and not self.squeeze

    def normalize(self, text: str) -> str:
        """``text`` as it is encoded: at each place the longest entry of the file's table is replaced by its form, pieces given by the user stay."""
        if self.units is not None:
            raw, units, out, i = text.encode("utf-8", "surrogatepass"), self.units, [], 0
            kept = self.user.match if self.user else None
            while i < len(raw):
                user = kept(raw, i) if kept else None
                if user:
                    out.append(user[0])
                    i = user.end()
                    continue
                at = (units[0] >> 10) << ((units[0] & 0x200) >> 6)
                best, form, j = 0, 0, i
                while j < len(raw):
                    at ^= raw[j]
                    unit = units[at] if at < len(units) else 0
                    if unit & 0x800000FF != raw[j]:
                        break
                    j += 1
                    at ^= (unit >> 10) << ((unit & 0x200) >> 6)
                    if unit >> 8 & 1:
                        best, form = j - i, units[at] & 0x7FFFFFFF
                if best:
                    out.append(self.forms[form : self.forms.index(b"\0", form)])
                else:
                    c = raw[i]
                    best = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
                    out.append(raw[i : i + best])
                i += best
            text = b"".join(out).decode("utf-8", "replace")
        return re.sub(" +", " ", text.strip(" ")) if self.squeeze else text

    # encoding

    def viterbi(self, segment: bytes) -> list[int]:
        """The best path over one string; at equal scores the longest last piece, as its start comes first."""
        n, base, check, value, scores = len(segment), self._lists[0], self._lists[1], self._lists[2], self._lists[3]
        best, back, piece = [-math.inf] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        size, i = len(check), 0
        while i < n:
            c = segment[i]
            width = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
            here, s, j, single = best[i], 0, i, False
            while j < n:
                t = base[s] + segment[j] + 1
                if t >= size or check[t] != s:
                    break
                s, j = t, j + 1
                v = value[s]
                if v >= 0:
                    single |= j == i + width
                    if here + scores[v] > best[j]:
                        best[j], back[j], piece[j] = here + scores[v], i, v
            j = min(n, i + width)
            if not single and here + self.unk_score > best[j]:
                best[j], back[j], piece[j] = here + self.unk_score, i, self.unk
            i += width
        path, at = [], n
        while at > 0:
            path.append((back[at], at, piece[at]))
            at = back[at]
        return self._ids(segment, path[::-1])

    @property
    def _lists(self) -> tuple[list[int], list[int], list[int], list[float]]:
        if "lists" not in self.__dict__:
            self.lists = (self.base.tolist(), self.check.tolist(), self.value.tolist(), self.scores.tolist())
        return self.lists

    def _ids(self, segment: bytes, path: list[tuple[int, int, int]]) -> list[int]:
        out: list[int] = []
        for a, b, v in path:
            out.extend(self.bytes[list(segment[a:b])].tolist() if v == self.unk and self.fallback else [v])
        return out

    def viterbi_many(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for many short strings at once, as flat ids and bounds: one step over all of them for each start and
        piece length."""
        n = len(segments)
        lens = np.array([len(s) for s in segments])
        width = int(lens.max())
        text = np.zeros((n, width + 4), np.uint8)
        flat = np.frombuffer(b"".join(segments), np.uint8)
        first = np.cumsum(lens) - lens
        text[np.repeat(np.arange(n), lens), np.arange(len(flat)) - np.repeat(first, lens)] = flat
        best = np.full((n, width + 5), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((n, width + 5), np.int16), np.zeros((n, width + 5), np.int32)
        size = len(self.check)
        for i in range(width):
            lead = text[:, i]
            rows = np.flatnonzero((lens > i) & ((lead & 0xC0) != 0x80))
            if not len(rows):
                continue
            c = lead[rows]
            step = np.where(c < 0x80, 1, np.where(c < 0xE0, 2, np.where(c < 0xF0, 3, 4)))
            single = np.zeros(len(rows), bool)
            live, state, j = np.arange(len(rows)), np.zeros(len(rows), np.int32), i
            while len(live) and j < width:
                at = rows[live]
                t = self.base[state] + text[at, j] + 1
                ok = (t < size) & (lens[at] > j)
                ok[ok] = self.check[t[ok]] == state[ok]
                live, state, j = live[ok], t[ok], j + 1
                v = self.value[state]
                hit = v >= 0
                if hit.any():
                    r, v = rows[live[hit]], v[hit]
                    single[live[hit]] |= step[live[hit]] == j - i
                    s = best[r, i] + self.scores[v]
                    up = s > best[r, j]
                    best[r[up], j], back[r[up], j], piece[r[up], j] = s[up], i, v[up]
            miss = np.flatnonzero(~single)
            if len(miss):
                r = rows[miss]
                j2 = np.minimum(i + step[miss], lens[r])
                s = best[r, i] + self.unk_score
                up = s > best[r, j2]
                r, j2 = r[up], j2[up]
                best[r, j2], back[r, j2], piece[r, j2] = s[up], i, self.unk
        at, rows = lens.copy(), np.arange(n)
        found: list[tuple[np.ndarray, ...]] = []
        while len(rows):
            b, v = back[rows, at[rows]], piece[rows, at[rows]]
            found.append((rows, b, at[rows], v))
            at[rows] = b
            rows = rows[b > 0]
        row, start, end, ids = (np.concatenate([f[i] for f in found]) for i in range(4))
        order = np.argsort(row * (width + 1) + start, kind="stable")
        row, start, end, ids = row[order], start[order].astype(np.int64), end[order], ids[order]
        if self.fallback and (ids == self.unk).any():
            times = np.where(ids == self.unk, end - start, 1)
            which = np.repeat(np.arange(len(ids)), times)
            within = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
            row, ids = row[which], np.where(ids[which] == self.unk, self.bytes[text[row[which], start[which] + within]], ids[which])
        return ids.astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])

    def _fill(self, missing: set[str]) -> None:
        cache = self.cache
        raw = [(m, m.encode("utf-8", "surrogatepass")) for m in missing]
        raw.sort(key=lambda x: len(x[1]))
        short = [(m, b) for m, b in raw if len(b) <= VECTOR_BYTES]
        for at in range(0, len(short), 8192):
            part = short[at : at + 8192]
            ids, first = self.viterbi_many([b for _, b in part])
            flat, ends = ids.tobytes(), (first * 4).tolist()
            cache.update((m, flat[x:y]) for (m, _), x, y in zip(part, ends, ends[1:]))
        for m, b in raw[len(short) :]:
            cache[m] = np.array(self.viterbi(b), np.int32).tobytes()

    def segments(self, text: str) -> list[str]:
        """Parts that no piece crosses: each ends before a run of blanks. With a piece that holds a blank after another
        character the text is one part."""
        text = text if self.identity else self.normalize(text)
        marked = ((" " if self.prefix else "") + text).replace(" ", MARK) if text else ""
        if self.crossing:
            return [marked] if marked else []
        if MARK + MARK in marked:
            return _PARTS.findall(marked)
        # NUL before each mark and around each line break: one split then keeps them
        return [p for p in marked.replace(MARK, "\x00" + MARK).replace("\n", "\x00\n\x00").split("\x00") if p] if "\x00" not in marked else _PARTS.findall(marked)

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids of each text; each distinct part is solved once while it stays in the cache."""
        parts = [None if t is None else self.segments(t) for t in texts]
        wanted = set().union(*(p for p in parts if p))
        missing = wanted.difference(self.cache)
        if missing and len(self.cache) + len(missing) > CACHE:
            self.cache, missing = {}, wanted
        if missing:
            self._fill(missing)
        get = self.cache.__getitem__
        return [None if p is None else np.frombuffer(b"".join(map(get, p)), np.int32) for p in parts]

    # decoding

    def decode_flat(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of texts of ids: pieces in a row, blanks for U+2581, byte pieces as bytes, control pieces
        as nothing, and the blank that stands before the text taken off. An id that the model hasn't reads as its unknown piece."""
        ids = np.where((ids < 0) | (ids >= len(self.length)), self.unk, ids)
        n = self.length[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        body = self.pool[np.arange(total) + np.repeat(self.at[ids] - (ends - n), n)]
        offsets = np.concatenate([[0], ends])[first]
        if self.prefix and total:
            start = offsets[:-1][np.diff(offsets) > 0]
            gone = start[body[start] == 32]
            keep = np.ones(total, bool)
            keep[gone] = False
            shift = np.zeros(total + 1, np.int64)
            shift[gone + 1] = 1
            return body[keep], offsets - np.cumsum(shift)[offsets]
        return body, offsets

    def decode(self, ids: list[int]) -> str:
        body, _ = self.decode_flat(np.asarray(ids, np.int64), np.array([0, len(ids)]))
        return body.tobytes().decode("utf-8", "replace")


_PARTS = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


class Codec:
    """Encodes in the scan; sent to executors with the trie, one cache a task."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Appends ids, their number and whether decoding them gives the text back to (..., text), without the text."""
        for batch in batches:
            keep = batch.num_columns - 1
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                column = part.column(keep)
                ids = self.model.encode_batch(column.to_pylist())
                n = np.array([0 if x is None else len(x) for x in ids], np.int64)
                first = np.concatenate([[0], np.cumsum(n)])
                flat = np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.int32)])
                body, offsets = self.model.decode_flat(flat, first)
                data, bounds, valid = buffers(column)
                if not self.model.identity:
                    data, bounds, _ = buffers(pa.array([None if x is None else self.model.normalize(x) for x in column.to_pylist()], pa.string()))
                same = np.diff(offsets) == np.diff(bounds)
                if not same.all() or len(body) != len(data) or not np.array_equal(body, data):
                    a, b = body.tobytes(), data.tobytes()
                    same = np.array([a[offsets[i] : offsets[i + 1]] == b[bounds[i] : bounds[i + 1]] for i in range(len(n))], bool)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat), mask=pa.array(~valid))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(keep)), lists, pa.array(n, mask=~valid), pa.array(same, mask=~valid)], [f"c{i}" for i in range(keep + 3)])


class Decoder:
    def __init__(self, model: PieceModel) -> None:
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Appends the text of (..., ids), without the ids; malformed UTF-8 becomes U+FFFD, a null id reads as the unknown piece."""
        for batch in batches:
            keep = batch.num_columns - 1
            texts = [None if x is None else self.model.decode([-1 if v is None else v for v in x]) for x in batch.column(keep).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(keep)), pa.array(texts, pa.string())], [f"c{i}" for i in range(keep + 1)])


def encode(df: DataFrame, text: str, path: str = DEFAULT_MODEL, ids: str = "ids") -> DataFrame:
    """``df`` with ``ids`` (array of int), ``n_tokens`` and ``round_trip`` (whether the ids decode to the text as the model normalises it, byte for
    byte; only a text that holds U+2581 itself, or any character unknown to a model without byte pieces, doesn't). At equal scores the path
    with the longest last piece wins. Repeated rows are encoded each, very long texts whole; an empty table stays empty.
    A null text has null in all three, an empty one no ids. No shuffle. Names that ``df`` has get leading
    underscores."""
    small_batches(df.sparkSession)
    a, b, c = fresh(df, ids), fresh(df, "n_tokens"), fresh(df, "round_trip")
    body = df.select(*(q(x) for x in df.columns), q(text).alias(a))
    return body.mapInArrow(Codec(PieceModel(path)), typed(df, f"`{a}` array<int>", f"`{b}` long", f"`{c}` boolean"))


def decode(df: DataFrame, ids: str, path: str = DEFAULT_MODEL, out: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids``; null for null, an empty text for no ids. Ids that the model hasn't and null elements read as the unknown
    piece."""
    small_batches(df.sparkSession)
    a = fresh(df, out)
    return df.select(*(q(x) for x in df.columns), q(ids).alias(a)).mapInArrow(Decoder(PieceModel(path)), typed(df, f"`{a}` string"))
