"""SentencePiece encoding and decoding by weighted finite-state transducers.

Three machines are compiled from a model file: the normaliser (blank to the piece mark, one mark in front), the
pieces (a trie whose final states emit a piece at the cost of its negative score) and the byte fallback (a character
that no piece spells emits its UTF-8 bytes). A text is composed with them into a lattice, and the shortest path under
(min, +) is its encoding. For a unigram model that is the whole rule. A merge model allows fewer paths: two pieces may
follow each other only if merging their letters gives the same two pieces again. The machine then remembers the last
piece; exactly one path is left, the one that merging finds.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from wirelens.llm import columns as C

#: Fixed values of the public model format: piece kinds, model kinds, the mark for a blank.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGES = 1, 2
MARK = "\u2581"
#: Distinct words of each of two generations whose pieces a worker remembers.
MEMO_WORDS = 150_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of one protocol-buffer message (public wire format)."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = number()
        if key & 7 == 0:
            value = number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            value = data[at:at + size]
            at += size
        yield key >> 3, value


@dataclass
class Transducer:
    """The compiled machines of one model."""

    surface: list[str]
    cost: list[float]
    kind: list[int]
    merges: bool
    dummy_prefix: bool
    squeeze: bool
    escape: bool
    ids: dict[str, int] = field(default_factory=dict)
    bytes_: dict[int, int] = field(default_factory=dict)
    trie: dict = field(default_factory=dict)
    unknown: int = 0
    unknown_cost: float = 0.0
    words_apart: bool = True
    price: dict[str, float] = field(default_factory=dict)
    joint: dict = field(default_factory=dict)

    # -- the machines

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if text and self.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK) if self.escape else text

    def merged(self, text: str) -> tuple[str, ...]:
        """Letters of a short string merged by best score first, leftmost among equals."""
        parts, price = list(text), self.price.get
        costs = [price(a + b, np.inf) for a, b in zip(parts, parts[1:])]
        while costs and (best := min(costs)) < np.inf:
            i = costs.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = price(parts[i - 1] + parts[i], np.inf)
            if i < len(costs):
                costs[i] = price(parts[i] + parts[i + 1], np.inf)
        return tuple(parts)

    def follows(self, last: int, piece: int) -> bool:
        """Whether a merge model can leave these two pieces side by side (numbers below 0 are characters of no piece)."""
        row = self.joint.get(last)
        if row is None:
            if len(self.joint) > 40_000:
                self.joint.clear()
            row = self.joint[last] = {}
        known = row.get(piece)
        if known is None:
            left, right = self.spelling(last), self.spelling(piece)
            known = row[piece] = self.merged(left + right) == (left, right)
        return known

    def spelling(self, number: int) -> str:
        return self.surface[number] if number >= 0 else chr(-number - 1)

    def shortest(self, text: str) -> list[int]:
        """Piece numbers on the shortest path of the lattice; of equal paths the one met first.

        A place of the lattice keeps one state: the cheapest. A merge model has no other, as the merged form of the
        letters so far is unique and its last piece is the state.
        """
        size, trie, merges, joint, costs, ids = len(text), self.trie, self.merges, self.joint, self.cost, self.ids
        sofar: list[float] = [np.inf] * (size + 1)
        back: list[tuple[int, int]] = [(0, 0)] * (size + 1)
        sofar[0] = 0.0
        for at in range(size):
            here = sofar[at]
            if here == np.inf:
                continue
            last = back[at][1] if at else None
            row = joint.get(last) if merges else None
            node, end = trie, at
            while end < size and (node := node.get(text[end])) is not None:
                end += 1
                piece = node.get("")
                if piece is None or here + costs[piece] >= sofar[end]:
                    continue
                if merges and at:
                    fits = row.get(piece) if row is not None else None
                    if fits is None:
                        fits = self.follows(last, piece)
                        row = joint[last]
                    if not fits:
                        continue
                sofar[end], back[end] = here + costs[piece], (at, piece)
            if text[at] not in ids and here + self.unknown_cost < sofar[at + 1]:
                letter = -ord(text[at]) - 1
                if not merges or not at or self.follows(last, letter):
                    sofar[at + 1], back[at + 1] = here + self.unknown_cost, (at, letter)
        out, at = [], size
        while at:
            at, piece = back[at]
            out.append(piece)
        return out[::-1]

    def encode_word(self, word: str) -> list[int]:
        """Ids of a normalised word: its path, with bytes (or the unknown piece) for characters without a piece."""
        out: list[int] = []
        for piece in self.shortest(word):
            if piece >= 0:
                out.append(piece)
            elif self.bytes_:
                out += [self.bytes_[b] for b in chr(-piece - 1).encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def encode(self, text: str) -> list[int]:
        text = self.normalise(text)
        return [i for word in self.words(text) for i in self.encode_word(word)]

    def words(self, text: str) -> list[str]:
        """Stretches that no piece crosses: a run of marks with what follows it."""
        if not self.words_apart:
            return [text]
        out, run = [], ""
        for i, part in enumerate(text.split(MARK)):
            run += MARK if i else ""
            if part:
                out.append(run + part)
                run = ""
        return out + [run] if run else out


def load(data: bytes) -> Transducer:
    """Compile a model file's content. Rewriting normalisers and user-defined pieces are not supported (ValueError)."""
    surface, cost, kind, settings, trainer = [], [], [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            surface.append(piece[1].decode())
            cost.append(-struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            kind.append(piece.get(3, NORMAL))
        elif number == 2:
            trainer = {n: v for n, v in _fields(value)}
        elif number == 3:
            settings = {n: v for n, v in _fields(value)}
    if settings.get(2):
        raise ValueError("the model rewrites characters; only identity normalisers are compiled")
    if USER in kind or trainer.get(24, 0):
        raise ValueError("user-defined pieces and marks as suffixes are not supported")
    model = trainer.get(3, UNIGRAM)
    if model not in (UNIGRAM, MERGES):
        raise ValueError("only unigram and merge models are transducers of pieces")
    t = Transducer(surface, cost, kind, model == MERGES, bool(settings.get(3, 1)), bool(settings.get(4, 1)), bool(settings.get(5, 1)))
    for i, (piece, k) in enumerate(zip(surface, kind)):
        if k == BYTE:
            t.bytes_[int(piece[3:-1], 16)] = i
        elif k == UNKNOWN:
            t.unknown = i
        elif k == NORMAL and piece:
            t.ids[piece], t.price[piece] = i, cost[i]
            node = t.trie
            for letter in piece:
                node = node.setdefault(letter, {})
            node[""] = i
    t.unknown_cost = max((cost[i] for i in t.ids.values()), default=0.0) + 10.0
    t.words_apart = t.escape and not any(MARK in p.lstrip(MARK) for p in t.ids)
    return t


class Lattices:
    """Shortest paths of many words at once: the same arcs, costs and admission as ``Transducer.shortest``."""

    SLOTS = 1 << 21

    def __init__(self, t: Transducer):
        self.t = t
        letters = sorted({x for piece in t.ids for x in piece})
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(x) for x in letters]] = np.arange(1, len(letters) + 1)
        nodes, keys, nexts, piece = [t.trie], [], [], [-1]
        for at, node in enumerate(nodes):  # grows while it is read: breadth first
            for x, below in node.items():
                if x:
                    keys.append(at * (len(letters) + 1) + int(self.letter[ord(x)]))
                    nexts.append(len(nodes))
                    nodes.append(below)
                    piece.append(below.get("", -1))
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.r_[np.array(keys, np.int64)[order], np.int64(1 << 62)]
        self.nexts = np.r_[np.array(nexts, np.int32)[order], np.int32(0)]
        self.piece, self.width = np.array(piece, np.int32), len(letters) + 1
        self.cost = np.array(t.cost)
        self.alone = np.zeros(0x110000, bool)  # characters that are pieces themselves
        self.alone[[ord(x) for x in t.ids if len(x) == 1]] = True
        self.pair, self.fits = np.full(self.SLOTS, -1, np.int64), np.zeros(self.SLOTS, bool)

    def arcs(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, length and piece of every arc; a character of no piece has number ``pieces + code``."""
        c = self.letter[codes]
        place, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        found = [(place[~self.alone[codes]], 1, len(self.cost) + codes[~self.alone[codes]].astype(np.int64))]
        depth = 0
        while len(place):
            key = node * self.width + c[place + depth]
            slot = np.searchsorted(self.keys, key)
            hit = self.keys[slot] == key
            place, node = place[hit], self.nexts[slot[hit]].astype(np.int64)
            depth += 1
            piece = self.piece[node]
            ends = piece >= 0
            found.append((place[ends], depth, piece[ends].astype(np.int64)))
            more = left[place] > depth
            place, node = place[more], node[more]
        return (np.concatenate([x[0] for x in found]), np.repeat([x[1] for x in found], [len(x[0]) for x in found]),
                np.concatenate([x[2] for x in found]))

    def admitted(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        key = last << 22 | piece
        slot = ((key * 0x9E3779B97F4A7C1) >> 20) & (self.SLOTS - 1)
        known = self.pair[slot] == key
        out = self.fits[slot]
        n = len(self.cost)
        number = lambda x: int(x) if x < n else -int(x - n) - 1
        for i in np.flatnonzero(~known):
            out[i] = self.fits[slot[i]] = self.t.follows(number(last[i]), number(piece[i]))
            self.pair[slot[i]] = key[i]
        return out

    def encode(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word."""
        t, n = self.t, len(self.cost)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.array([len(w) for w in words])
        ends = np.cumsum(lengths)
        word = np.repeat(np.arange(len(words)), lengths)
        inside = np.arange(len(codes)) - (ends - lengths)[word]
        place, length, piece = self.arcs(codes, ends[word] - np.arange(len(codes)))
        order = np.argsort(inside[place], kind="stable")
        place, length, piece = place[order], length[order], piece[order]
        cuts = np.searchsorted(inside[place], np.arange(int(lengths.max(initial=0)) + 1))
        node = place + word[place]  # lattice places: one more than letters in each word
        price = np.where(piece < n, self.cost[np.minimum(piece, n - 1)], t.unknown_cost)
        sofar, last, back = (np.full(len(codes) + len(words), x) for x in (np.inf, 0, 0))
        last, back = last.astype(np.int64), back.astype(np.int64)
        sofar[ends - lengths + np.arange(len(words))] = 0.0
        for j in range(len(cuts) - 1):
            a = slice(cuts[j], cuts[j + 1])
            start, to, what = node[a], node[a] + length[a], piece[a]
            total = sofar[start] + price[a]
            good = total < sofar[to]
            if t.merges and j:
                good[good] = self.admitted(last[start[good]], what[good])
            to = to[good]
            sofar[to], last[to], back[to] = total[good], what[good], length[a][good]
        at, of, steps = ends + np.arange(len(words)), np.arange(len(words)), []
        while len(at):
            more = back[at] > 0
            at, of = at[more], of[more]
            steps.append((of, last[at]))
            at = at - back[at]
        owner, flat = np.concatenate([x[0] for x in steps][::-1]), np.concatenate([x[1] for x in steps][::-1])
        order = np.argsort(owner, kind="stable")
        owner, flat = owner[order], flat[order]
        odd = np.flatnonzero(flat >= n)
        if len(odd):
            chars = np.unique(flat[odd])
            spelled = [[t.bytes_[b] for b in chr(int(x - n)).encode("utf-8", "surrogatepass")] if t.bytes_ else [t.unknown] for x in chars]
            many = np.ones(len(flat), np.int64)
            at = np.searchsorted(chars, flat[odd])
            many[odd] = np.array([len(x) for x in spelled])[at]
            first = np.repeat(np.cumsum(many) - many, many)
            step = np.arange(int(many.sum())) - first
            owner, source = np.repeat(owner, many), np.repeat(flat, many)
            table = np.zeros((len(chars), 4), np.int64)
            for i, x in enumerate(spelled):
                table[i, :len(x)] = x
            strange = source >= n
            source[strange] = table[np.searchsorted(chars, source[strange]), step[strange]]
            flat = source
            if not t.bytes_:  # runs of unknown characters are one piece
                keep = ~((flat == t.unknown) & (np.r_[-1, flat[:-1]] == t.unknown) & (np.r_[-1, owner[:-1]] == owner))
                owner, flat = owner[keep], flat[keep]
        return np.split(flat.astype(np.int32), np.searchsorted(owner, np.arange(1, len(words))))


class Memo:
    """Pieces of words met lately: two generations, so that common words stay while rare ones are forgotten."""

    def __init__(self, t: Transducer):
        self.lattices, self.young, self.old = Lattices(t), {}, {}

    def pieces(self, words: list[str]) -> list[np.ndarray]:
        found, young, old = [], self.young, self.old
        for word in words:
            ids = young.get(word)
            if ids is None and (ids := old.get(word)) is not None:
                young[word] = ids
            found.append(ids)
        missing = [i for i, ids in enumerate(found) if ids is None]
        new = self.lattices.encode([words[i] for i in missing]) if missing else []
        for i, ids in zip(missing, new):
            found[i] = ids
            if len(words[i]) <= 64:
                young[words[i]] = ids.copy()
        if len(young) >= MEMO_WORDS:
            self.young, self.old = {}, young
        return found


@lru_cache(maxsize=1)
def _worker(model: bytes) -> tuple[Transducer, Memo]:
    """The machines and the memory of one Python worker, kept from task to task."""
    t = load(model)
    return t, Memo(t)


def _flat(t: Transducer, texts: pa.Array, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and how many each text has."""
    if not t.words_apart or t.squeeze or not t.dummy_prefix:
        lists = [t.encode(x) for x in texts.to_pylist()]
        return np.array([i for x in lists for i in x], np.int32), np.array([len(x) for x in lists], np.int64)
    # a mark before each word: blanks become marks, with one in front of every text that is not empty
    marked = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise("", pc.replace_substring(texts, " ", MARK), MARK))
    # words start at a mark that follows none; what follows a run of marks belongs to it
    cut = pc.replace_substring_regex(marked, f"([^{MARK}])({MARK})", "\\1\x00\\2") if not _has_zero(texts) else None
    if cut is None:
        lists = [t.encode(x) for x in texts.to_pylist()]
        return np.array([i for x in lists for i in x], np.int32), np.array([len(x) for x in lists], np.int64)
    lists = pc.split_pattern(cut, "\x00")
    flat, rows = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(flat)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    found = memo.pieces(coded.dictionary.to_pylist())
    lengths = np.array([len(x) for x in found], np.int64)
    pool, begins = np.concatenate([*found, np.zeros(0, np.int32)]), np.cumsum(lengths) - lengths
    each = lengths[codes]
    total = int(each.sum())
    place = np.arange(total) - np.repeat(np.cumsum(each) - each, each) + np.repeat(begins[codes], each)
    counts = np.bincount(rows, each, len(texts)).astype(np.int64) if len(rows) else np.zeros(len(texts), np.int64)
    return pool[place], counts


def _has_zero(texts: pa.Array) -> bool:
    return bool((C.raw(texts)[0] == 0).any())


def _decoded(t: Transducer, ids: np.ndarray, counts: np.ndarray, spelled: pa.Array) -> pa.Array:
    """Texts of runs of ids: pieces spelled out, marks back to blanks, the mark in front taken off."""
    flat = spelled.take(pa.array(ids))
    data, offsets = C.raw(flat)
    ends = offsets[np.r_[0, np.cumsum(counts)]]
    texts = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data.tobytes())])
    try:
        texts = texts.cast(pa.string())
    except pa.ArrowInvalid:
        texts = pa.array([x.decode("utf-8", "replace") for x in texts.to_pylist()], pa.string())
    if t.escape:
        texts = pc.replace_substring(texts, MARK, " ")
    return pc.replace_substring_regex(texts, "^ ", "") if t.dummy_prefix else texts


def _spelled(t: Transducer) -> pa.Array:
    out = [p.encode() for p in t.surface]
    for b, i in t.bytes_.items():
        out[i] = bytes([b])
    for i, k in enumerate(t.kind):
        if k == CONTROL:
            out[i] = b""
        elif k == UNKNOWN:
            out[i] = " \u2047 ".encode()
    return pa.array(out, pa.binary())


def encode(docs: DataFrame, model: bytes, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), back: bool = False) -> DataFrame:
    """``keep`` columns plus pieces, the ids of the whole text, for every row. A null or empty text has none.

    With ``back`` also decoded, the text that these ids spell, decoded in the same pass.
    """
    def task(batches):
        t, memo = _worker(model)
        spelled = _spelled(t) if back else None
        for part in C.slices(batches, given):
            ids, counts = _flat(t, C.filled(part.column(given)), memo)
            columns = [part.column(i) for i, name in enumerate(part.schema.names) if name != "__text"]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids)).cast(shape.field("pieces").type)
            more = [_decoded(t, ids, counts, spelled).cast(pa.string())] if back else []
            yield pa.RecordBatch.from_arrays([*columns, lists, *more], schema=shape)

    out = StructType([*docs.select(*keep).schema.fields, StructField("pieces", ArrayType(IntegerType())), *([StructField("decoded", StringType())] if back else [])])
    shape = to_arrow_schema(out)
    inputs, given = C.with_text(docs, keep, text)
    return inputs.mapInArrow(C.lean(task), out)


def decode(encoded: DataFrame, model: bytes, *, pieces: str = "pieces", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus decoded, the text that the ids spell; null or no ids give the empty text.

    Null ids, or ids that the model has not, are passed over. Encoding loses only the literal mark character, which
    decodes as a blank.
    """
    def task(batches):
        t, _ = _worker(model)
        spelled = _spelled(t)
        for part in batches:
            lists = part.column("__ids")
            flat = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            good = (flat >= 0) & (flat < len(spelled))
            rows = np.repeat(np.arange(len(counts)), counts)
            texts = _decoded(t, flat[good], np.bincount(rows[good], minlength=len(counts)).astype(np.int64), spelled)
            columns = [part.column(i) for i, name in enumerate(part.schema.names) if name != "__ids"]
            yield pa.RecordBatch.from_arrays([*columns, texts.cast(pa.string())], schema=shape)

    out = StructType([*encoded.select(*keep).schema.fields, StructField("decoded", StringType())])
    shape = to_arrow_schema(out)
    return encoded.select(*keep, F.col(pieces).alias("__ids")).mapInArrow(task, out)


def read_model(spark, path: str) -> bytes:
    """Content of a model file, read by Spark so that any store will do. Its size is that of one vocabulary."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
