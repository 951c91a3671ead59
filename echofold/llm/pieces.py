"""SentencePiece encoding by streaming Viterbi search, and decoding.

A vocabulary file gives the pieces.  A piece's log-probability follows Zipf's
law over its rank in the file's order of merges (pieces without a rank of their
own come last, bytes after all others); a text's encoding is the likeliest
sequence of pieces.  Characters that no chosen piece covers are spelled as the
pieces of their UTF-8 bytes.

The search goes through the characters in order.  It keeps the best way to reach
each position of a window; paths can only go on from the last ``longest`` of
them.  When all of these lead back through one boundary, the ids before it are
final: they are given out, and what lies behind is dropped.  So memory follows
the longest piece, not the text.

As no piece has a space after another character, every path passes through the
boundary before a run of spaces: a text falls into chunks that are encoded by
themselves.  The distinct short chunks of some megabytes of text are searched side
by side; a long chunk (a text without spaces, say) goes through the streaming
window.  A very long text is cut at such boundaries too, so that its chunks are
never all held at once.

A space is written as U+2581, with one more in front of the text; a real U+2581
is spelled in bytes, so that every text is restored exactly.

Defined results: a null text has null ids and decodes to null, an empty text has
no ids; repeated rows each get a result; of ways that are equally likely the one
with the longest last piece is taken; other columns do not matter, whatever
their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Lookup, lean, ranges, table

SPACE = "▁"
#: Characters between two looks at whether all paths have met.
_WINDOW = 256
_NEVER = -math.inf
#: Characters of chunks that are searched side by side, and bytes of text whose chunks are looked up at once.
_LANE_CHARS, _PART = 1 << 14, 1 << 21
_BAR = SPACE.encode()
#: Where a long text may be cut: before a run of spaces.
_BORDER = re.compile(b"(?<! ) ")


@dataclass(frozen=True)
class PieceParams:
    #: A SentencePiece model file on the driver.
    path: str = "/opt/tokenizers/piece_bpe_32k.model"
    #: Longest chunk that is searched side by side with others; longer ones stream by themselves. It bears on time, not on results.
    lane_chars: int = 48


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their log-probabilities, and the ids of the 256 bytes. Of fixed size: the file's."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    #: Id of each byte value.
    bytes_at: tuple[int, ...]
    #: Ids that stand for text.
    usable: frozenset[int]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        pieces = [m.id_to_piece(i) for i in range(n)]
        spelled = {int(p[3:5], 16): i for i, p in enumerate(pieces) if m.is_byte(i)}
        usable = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        rank = {i: r for r, i in enumerate(sorted(usable, key=lambda i: (-m.get_score(i), i)))}
        total = math.log(sum(1 / (r + 2) for r in range(n)))
        scores = [-math.log(rank.get(i, n) + 2) - total for i in range(n)]
        return cls(tuple(pieces), tuple(scores), tuple(spelled[b] for b in range(256)), frozenset(usable))


def _utf8(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """([character, 4] bytes, how many) of code points, surrogates included; what is beyond is 256."""
    size = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    out = np.full((len(code), 4), 256)
    for n in (1, 2, 3, 4):
        c = code[size == n]
        lead = c if n == 1 else (0xF00 >> n & 0xFF) | c >> 6 * (n - 1)
        out[size == n, :n] = np.stack([lead, *(0x80 | c >> 6 * (n - 1 - k) & 0x3F for k in range(1, n))], axis=1)
    return out, size


class _Trie:
    """The pieces as arrays: every character and node has a number, 0 being none and the root."""

    def __init__(self, piece: dict[str, tuple[float, tuple[int, ...]]]):
        letters = sorted(set("".join(piece)))
        #: Number of each code point.
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        node_of = {p: k for k, p in enumerate(sorted({p[:k] for p in piece for k in range(len(p) + 1)}))}
        inner = [p for p in node_of if p]
        keys = np.array([node_of[p[:-1]] * self.width + int(self.letter[ord(p[-1])]) for p in inner], np.int64)
        child = np.array([node_of[p] for p in inner], np.int64)
        self.edges, self.child = Lookup(keys), np.r_[child, 0]
        #: The piece that ends at a node, or -1; the log-probability of each piece.
        self.id = np.full(len(node_of), -1, np.int32)
        self.score_of = np.zeros(1 + max(i for _, (i,) in piece.values()))
        for p, (score, (i,)) in piece.items():
            self.id[node_of[p]], self.score_of[i] = i, score

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The child of each node under a letter, or 0."""
        return self.child[self.edges.get(node * self.width + letter)]


class Encoder:
    def __init__(self, v: Vocabulary, lane_chars: int = 48):
        self.v = v
        self.piece = {v.pieces[i]: (v.scores[i], (i,)) for i in v.usable}
        #: Pieces, and () for what only begins one.
        self.trie = {p[:k]: () for p in self.piece for k in range(1, len(p) + 1)} | self.piece
        self.longest = max(map(len, self.piece))
        self.text_of = [b""] * len(v.pieces)
        for i in v.usable:
            self.text_of[i] = v.pieces[i].replace(SPACE, " ").encode()
        for b, i in enumerate(v.bytes_at):
            self.text_of[i] = bytes([b])
        self.lane_chars = lane_chars
        self.bytes_at, self.byte_score = np.array([*v.bytes_at, 0]), np.array([*(v.scores[i] for i in v.bytes_at), 0.0])
        own = np.zeros(256, bool)
        own[[c for c in range(128) if c != 32 and not any(chr(c) in p for p in self.piece)]] = True
        #: Bytes that are no part of any piece: chunks of their own.
        self.own = own
        #: Whether all paths meet before every run of spaces.
        self.free = not any(SPACE in p.lstrip(SPACE) for p in self.piece)

    @cached_property
    def arrays(self) -> _Trie:
        return _Trie(self.piece)

    def stream(self, s: str) -> Iterator[tuple[int, ...]]:
        """The ids of a string in tuples, given out as soon as they are certain."""
        longest, trie, bytes_at, scores = self.longest, self.trie, self.v.bytes_at, self.v.scores
        n, base, look = len(s), 0, _WINDOW
        size = min(n, _WINDOW) + longest + 1
        # of the positions from `base` on: log-probability, the position before, the ids between
        best, before, ids = [_NEVER] * size, [0] * size, [()] * size
        best[0] = 0.0
        for i in range(n):
            r = i - base
            here = best[r]
            if s[i] not in trie or not trie[s[i]]:
                spelled = tuple(bytes_at[b] for b in s[i].encode("utf-8", "surrogatepass"))
                score = here + sum(scores[b] for b in spelled)
                if score > best[r + 1]:
                    best[r + 1], before[r + 1], ids[r + 1] = score, r, spelled
            for end in range(i + 1, min(n, i + longest) + 1):
                found = trie.get(s[i:end])
                if found is None:
                    break
                if found:
                    score = here + found[0]
                    if score > best[end - base]:
                        best[end - base], before[end - base], ids[end - base] = score, r, found[1]
            if r + 1 == look and i + 1 < n:
                # every later path goes on from one of these positions; where do all of them lead back to?
                at = {p for p in range(r + 1, min(r + 1 + longest, len(best))) if best[p] > _NEVER}
                while len(at) > 1:
                    last = max(at)
                    at.remove(last)
                    at.add(before[last])
                meet = at.pop()
                # what lies before that is final; if it is the start, the window grows until they meet
                yield from self._path(before, ids, meet)
                more = max(meet, 0 if meet else _WINDOW)
                best = best[meet:] + [_NEVER] * more
                before = [max(0, p - meet) for p in before[meet:]] + [0] * more
                ids = ids[meet:] + [()] * more
                base += meet
                look += 0 if meet else _WINDOW
        yield from self._path(before, ids, n - base)

    @staticmethod
    def _path(before: list[int], ids: list[tuple[int, ...]], end: int) -> list[tuple[int, ...]]:
        out = []
        while end > 0:
            out.append(ids[end])
            end = before[end]
        out.reverse()
        return out

    def _lanes(self, code: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all, how many of each) of short chunks that stand one after another: the search of ``stream``, over all of them side by side.

        A chunk is one window here, given out at its end, where all paths meet."""
        trie, n, total = self.arrays, len(size), len(code)
        first = np.cumsum(size) - size
        lane = np.repeat(np.arange(n), size)
        letter = trie.letter[code].astype(np.int64)
        # a space stands for U+2581, a real U+2581 for itself, which is no part of a piece
        letter[code == ord(SPACE)] = 0
        letter[code == 32] = trie.letter[ord(SPACE)]
        # all pieces at all places, by length: a walk goes on where a longer piece may
        place, room = np.arange(total), np.repeat(first + size, size) - np.arange(total)
        node = trie.step(np.zeros(total, np.int64), letter)
        place, node = place[node > 0], node[node > 0]
        at, long, ids = [], [], []
        for d in range(1, self.longest + 1):
            whole = trie.id[node] >= 0
            at.append(place[whole])
            ids.append(trie.id[node[whole]].astype(np.int64))
            long.append(np.full(len(at[-1]), d))
            on = room[place] > d
            place, node = place[on], node[on]
            node = trie.step(node, letter[place + d])
            place, node = place[node > 0], node[node > 0]
            if not len(place):
                break
        # a character that is no piece by itself is spelled; it stands as the negative of its code point
        alone = np.ones(total, bool)
        alone[at[0]] = False
        alone = np.flatnonzero(alone)
        spelled = np.where(code[alone] == 32, ord(SPACE), code[alone]).astype(np.int64)
        at, long, ids = np.concatenate([alone, *at]), np.concatenate([np.ones(len(alone), np.int64), *long]), np.concatenate([-1 - spelled, *ids])
        score = np.empty(len(at))
        score[len(alone) :] = trie.score_of[ids[len(alone) :]]
        score[: len(alone)] = self.byte_score[_utf8(spelled)[0]].sum(axis=1)
        # forward by the places within the chunks; pieces from one place end at different ones, so no two meet
        offset = at - first[lane[at]]
        order = np.argsort(offset.astype(np.uint8), kind="stable")
        own = lane[at]
        begin, end = offset * n + own, (offset + long) * n + own
        most = int(size.max())
        best, back = np.full((most + 1) * n, _NEVER), np.zeros((most + 1) * n, np.int64)
        best[:n] = 0.0
        cuts = np.searchsorted(offset[order], np.arange(most + 1))
        for i in range(most):
            m = order[cuts[i] : cuts[i + 1]]
            sums = best[begin[m]] + score[m]
            better = sums > best[end[m]]
            m = m[better]
            best[end[m]], back[end[m]] = sums[better], m
        # from the ends back to the starts, all chunks at once
        spot, steps, n_ids = size * n + np.arange(n), [], np.zeros(n, np.int64)
        live = np.arange(n)
        while len(live):
            m = back[spot[live]]
            spot[live] = begin[m]
            steps.append((live, ids[m]))
            n_ids[live] += 1
            live = live[spot[live] >= n]
        flat, stop = np.empty(int(n_ids.sum()), np.int64), np.cumsum(n_ids)
        for k, (live, own) in enumerate(steps):
            flat[stop[live] - 1 - k] = own
        if not len(alone):
            return flat, n_ids
        data, sizes = _utf8(np.where(flat < 0, -1 - flat, 0))
        times = np.where(flat < 0, sizes, 1)
        out = np.repeat(flat, times)
        byte = data[np.repeat(np.arange(len(flat)), times), ranges(times)]
        out = np.where(out < 0, self.bytes_at[byte], out)
        return out, np.add.reduceat(times, stop - n_ids)

    def _learn(self, chunks: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all, how many of each) of distinct chunks."""
        offsets = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset : chunks.offset + len(chunks) + 1].astype(np.int64)
        data = np.frombuffer(chunks.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        code = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        border = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets - offsets[0]]
        size = np.diff(border)
        n_ids, parts = np.zeros(len(size), np.int64), []
        # long chunks stream by themselves; the others go in groups of like length
        order = np.argsort(size, kind="stable")
        ends = np.cumsum(size[order])
        short, at = int(np.searchsorted(size[order], self.lane_chars, side="right")), 0
        while at < short:
            end = min(short, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _LANE_CHARS))))
            own = order[at:end]
            ids, n_ids[own] = self._lanes(code[ranges(size[own]) + np.repeat(border[own], size[own])], size[own])
            parts.append(ids)
            at = end
        for k in order[short:]:
            s = code[border[k] : border[k + 1]].tobytes().decode("utf-32-le", "surrogatepass").replace(" ", SPACE)
            parts.append(np.array([i for part in self.stream(s) for i in part], np.int64))
            n_ids[k] = len(parts[-1])
        flat = np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int32)
        # from the order of lengths back to that of the chunks
        n = n_ids[order]
        begin = np.empty(len(order), np.int64)
        begin[order] = np.cumsum(n) - n
        return flat[np.repeat(begin, n_ids) + ranges(n_ids)], n_ids

    def _starts(self, flat: np.ndarray, data: bytes, begin: np.ndarray) -> np.ndarray:
        """Where the chunks of texts begin that stand one after another."""
        first = np.zeros(len(flat) + 1, bool)
        first[begin] = True
        if self.free:
            space, own = flat == 32, self.own[flat]
            first[:-1] |= own
            first[1:-1] |= (space[1:] & ~space[:-1]) | own[:-1]
        for m in re.finditer(_BAR, data):
            first[m.start()] = first[m.end()] = True
        return np.flatnonzero(first[:-1])

    def _parts(self, text: bytes) -> Iterator[bytes]:
        """A text with a space in front, in parts of bounded size where it has spaces."""
        text, at = b" " + text, 0
        while self.free and len(text) - at > _PART and (cut := _BORDER.search(text, at + _PART)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def _flush(self, parts: list[bytes]) -> list[np.ndarray]:
        """The ids of parts of texts, whose chunks are looked up together."""
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        begin = np.cumsum(size) - size
        data = b"".join(parts)
        start = self._starts(np.frombuffer(data, np.uint8), data, begin)
        offsets = pa.py_buffer(np.r_[start, len(data)].astype(np.int32))
        found = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        which = found.indices.to_numpy()
        flat, n = self._learn(found.dictionary)
        per = n[which]
        ends = np.cumsum(per)
        ids = flat[np.repeat((np.cumsum(n) - n)[which], per) + ranges(per)]
        return np.split(ids, np.r_[0, ends][np.searchsorted(start, begin[1:])])

    def encode_all(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of whole texts, given as UTF-8."""
        out, of, held, size = [[] for _ in texts], [], [], 0

        def flush() -> None:
            for k, ids in zip(of, self._flush(held) if held else (), strict=True):
                out[k].append(ids)
            of.clear()
            held.clear()

        for k, text in enumerate(texts):
            for part in self._parts(text) if text else ():
                of.append(k)
                held.append(part)
                size += len(part)
                if size > _PART:
                    flush()
                    size = 0
        flush()
        return [x[0] if len(x) == 1 else np.concatenate([np.zeros(0, np.int32), *x]) for x in out]

    def encode(self, text: str) -> array:
        """The ids of a whole text."""
        return array("i", self.encode_all([text.encode("utf-8", "surrogatepass")])[0].tobytes())

    def spell(self, ids) -> bytes:
        """The UTF-8 bytes that ids stand for, without the space in front."""
        return b"".join(map(self.text_of.__getitem__, ids))[1:]

    def decode(self, ids) -> str:
        return self.spell(ids).decode("utf-8", "surrogatepass")


def encode(docs: DataFrame, params: PieceParams = PieceParams(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, ids array<int>, n_ids long, decoded_sha256 (of the text that the ids decode to)."""
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(params.path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(sent.value, params.lane_chars)
        for b in lean(batches):
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                texts = part.column(1).cast(pa.binary()).to_pylist()
                null = [t is None for t in texts]
                ids = enc.encode_all([t or b"" for t in texts])
                # out in small batches: what the JVM holds of them at once follows their size
                for at in range(0, len(ids), 128):
                    own, no = ids[at : at + 128], null[at : at + 128]
                    digest = [None if nil else hashlib.sha256(enc.spell(x.tolist())).hexdigest() for x, nil in zip(own, no, strict=True)]
                    n = np.array([len(x) for x in own])
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(np.concatenate(own)), mask=pa.array(no))
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(at, 128), lists, pa.array(n, pa.int64(), mask=np.array(no)), pa.array(digest, pa.string())], names=[id_col, "ids", "n_ids", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, n_ids long, decoded_sha256 string")


def decode(encoded: DataFrame, params: PieceParams = PieceParams(), *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of encoded documents."""
    sent = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(params.path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(sent.value)
        for b in batches:
            texts = [None if x is None else enc.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {kind}, text string")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
