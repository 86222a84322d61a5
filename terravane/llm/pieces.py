"""SentencePiece encoding and decoding as a shortest path in a weighted transducer.

The transducer is compiled from a model's vocabulary.  Its parts, applied in one pass:

* the normaliser: a dummy space in front, spaces written as U+2581;
* the pieces: a trie, whose accepting states emit an id;
* byte fallback: a character that is no piece emits one id for each of its UTF-8 bytes.

A state of the composition with an input is (position, last piece).  The weight of an arc depends
on the model.  For a unigram model it is minus the piece's score, and the tropical shortest path
is the best segmentation.  For a byte-pair model scores only rank merges, and a sum of them means
nothing; there an arc from piece u to piece v weighs 0 if merging the characters of uv ends in
(u, v), and is absent otherwise.  A sequence is what merging makes of a text exactly if all its
neighbours are such pairs, so one path remains, and it is the model's own encoding.

No piece reaches over a border between a non-space and a space, so the composition falls apart
into words there; a worker remembers the paths of the words it has met.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm.common import Hidden, held, with_fields

SPACE = "▁"
#: Bounds of what a worker remembers: bytes of words, about what a word costs beside its characters
#: and ids, characters of a word worth remembering, marks of words met once, and pairs of pieces (of
#: some 100 bytes each).
MEMORY_BYTES, ENTRY, LONG_WORD, MARKS, MEMORY_PAIRS = 24 << 20, 220, 256, 1 << 21, 250_000
#: Kinds of pieces and models in the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Stands for the symbol before the first.
START = (1 << 21) - 1


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""

    def number(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[i]
            value |= (byte & 127) << shift
            i, shift = i + 1, shift + 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(data):
        tag, i = number(i)
        if tag & 7 == 0:
            value, i = number(i)
        elif tag & 7 == 2:
            size, i = number(i)
            value, i = data[i : i + size], i + size
        else:
            size = 4 if tag & 7 == 5 else 8
            value, i = data[i : i + size], i + size
        yield tag >> 3, value


class Memory(dict):
    """Remembered results; of twice MEMORY_BYTES those asked for least recently are forgotten.

    A word is remembered when it comes for the second time, so words that occur once cost no memory.
    """

    def __init__(self, make) -> None:
        self.make, self.old, self.size, self.met = make, {}, 0, bytearray(MARKS)

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.make(word)
            mark = hash(word) % MARKS
            if not self.met[mark] or len(word) > LONG_WORD:
                self.met[mark] = 1
                return found
        self.size += ENTRY + 2 * len(word) + len(found)
        if self.size > MEMORY_BYTES:
            self.old = dict(self)
            self.clear()
            self.met = bytearray(MARKS)
            self.size = ENTRY + 2 * len(word) + len(found)
        self[word] = found
        return found


class Transducer:
    """The compiled model."""

    def __init__(self, model: bytes) -> None:
        self.texts, self.scores, self.kinds = [], [], []
        kind, normal = UNIGRAM, {}
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                self.texts.append(piece.get(1, b"").decode())
                self.scores.append(float(np.frombuffer(piece[2], dtype="<f4")[0]) if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                normal = dict(_fields(value))
        if normal.get(2) or kind not in (UNIGRAM, BPE):
            raise ValueError("only identity normalisers of unigram and byte-pair models are compiled")
        if normal.get(4, 1) or USER in self.kinds:
            raise ValueError("models that squeeze spaces or match symbols of their own are not compiled")
        self.bpe, self.dummy = kind == BPE, bool(normal.get(3, 1))
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.texts, self.kinds, strict=True)) if k == NORMAL}
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.texts, self.kinds, strict=True)) if k == BYTE}
        self.penalty = 10 - min(self.scores)
        self.trie: dict = {}
        for text, i in self.ids.items():
            node = self.trie
            for c in text:
                node = node.setdefault(c, {})
            node[""] = i
        joined = [t for t in self.ids if SPACE in t.lstrip(SPACE)]
        if joined:
            raise ValueError("a piece has a space after other characters")
        # A character within no longer piece ends every path before and after it.
        inner = {c for t in self.ids if len(t) > 1 for c in t}
        apart = "".join(c for c in "\n\t\r" if c not in inner)
        self.cut = re.compile(f"{SPACE}*[^{SPACE}{apart}]+|{SPACE}+" + (f"|[{apart}]" if apart else "")).findall
        self.words, self.pairs = Memory(self.word), {}
        self.surface = [bytes([int(t[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else t.replace(SPACE, " ").encode() for t, k in zip(self.texts, self.kinds, strict=True)]
        self.surface[self.unknown] = " ⁇ ".encode()

    def text(self, symbol: int) -> str:
        """A symbol is a piece's id, or SIZE and the number of a character that is no piece."""
        return self.texts[symbol] if symbol < len(self.texts) else chr(symbol - len(self.texts))

    def merged(self, text: str) -> list[str]:
        """What merging makes of a short text: the best-scored neighbours first, leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            found = [(self.scores[i], -k) for k, pair in enumerate(zip(parts, parts[1:], strict=False)) if (i := self.ids.get("".join(pair))) is not None]
            if not found:
                break
            k = -max(found)[1]
            parts[k : k + 2] = ["".join(parts[k : k + 2])]
        return parts

    def apart(self, u: int, v: int) -> bool:
        """Whether merging leaves the symbols u and v as neighbours, or v alone at the start (u = START)."""
        if len(self.pairs) >= MEMORY_PAIRS:
            self.pairs.clear()
        parts = ([] if u == START else [self.text(u)]) + [self.text(v)]
        known = self.pairs[u << 21 | v] = self.merged("".join(parts)) == parts
        return known

    def merge_path(self, word: str) -> list[int]:
        """The path of a byte-pair model, the longest symbol tried first.

        A beginning of the word has one path only, so a place from which none leads on is never
        tried again, whatever symbol ends there.
        """
        n, size, root, pairs = len(word), len(self.texts), self.trie, self.pairs
        dead = bytearray(n + 1)
        out: list[int] = []
        # Where each symbol of ``out`` starts, and those that are left to try there.
        starts: list[int] = []
        untried: list[list[int]] = []
        i, u, back, left = 0, START, False, []
        while i < n:
            if not back:
                node = root.get(word[i])
                j = i + 1
                left = [] if node is not None and "" in node else [size + ord(word[i]), j]
                while node is not None:
                    v = node.get("")
                    if v is not None:
                        left += (v, j)
                    if j == n:
                        break
                    node = node.get(word[j])
                    j += 1
            back = True
            while left:
                j, v = left.pop(), left.pop()
                if dead[j]:
                    continue
                good = pairs.get(u << 21 | v)
                if good is None:
                    good = self.apart(u, v)
                if good:
                    back = False
                    break
            if back:
                dead[i] = 1
                out.pop()
                i, left = starts.pop(), untried.pop()
                u = out[-1] if out else START
            else:
                out.append(v)
                starts.append(i)
                untried.append(left)
                i, u = j, v
        return out

    def score_path(self, word: str) -> list[int]:
        """The path of a unigram model: the largest sum of scores, an unknown character at a penalty."""
        n, size = len(word), len(self.texts)
        cost, last = [0.0] + [float("inf")] * n, [0] * (n + 1)
        for i in range(n):
            node, j, arcs = self.trie.get(word[i]), i + 1, []
            if node is None or "" not in node:
                arcs.append((j, size + ord(word[i]), self.penalty))
            while node is not None:
                if "" in node:
                    arcs.append((j, node[""], -self.scores[node[""]]))
                if j == n:
                    break
                node = node.get(word[j])
                j += 1
            for end, v, weight in arcs:
                if cost[i] + weight < cost[end]:
                    cost[end], last[end] = cost[i] + weight, v
        out = []
        while n:
            out.append(last[n])
            n -= len(self.texts[last[n]]) if last[n] < size else 1
        return out[::-1]

    def word(self, word: str) -> bytes:
        """The ids of a word, as 32-bit numbers."""
        path = self.merge_path(word) if self.bpe else self.score_path(word)
        size = len(self.texts)
        if max(path) >= size:
            ids: list[int] = []
            for v in path:
                if v < size:
                    ids.append(v)
                elif self.bytes:
                    ids.extend(self.bytes[b] for b in self.text(v).encode())
                else:
                    ids.append(self.unknown)
            path = ids
        return array("i", path).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        if not text:
            return np.zeros(0, dtype=np.int32)
        words = self.cut((SPACE if self.dummy else "") + text.replace(" ", SPACE))
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 give U+FFFD."""
        text = b"".join(map(self.surface.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


def _transducer(name: str, model) -> Transducer:
    return held(("pieces", name), lambda: Transducer(model.value))


def _encode(name: str, model, schema: pa.Schema):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _transducer(name, model)
        first = min(machine.bytes.values(), default=-1)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids, fallback, same, ends = [], [], [], [0]
                for value in part.column("_text"):
                    text = value.as_py() or ""
                    found = machine.encode(text)
                    ids.append(found)
                    ends.append(ends[-1] + len(found))
                    fallback.append(int(((found >= first) & (found < first + 256)).sum()) if machine.bytes else 0)
                    same.append(machine.decode(found) == text)
                lists = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(np.concatenate(ids)))
                made = {"ids": lists, "n_ids": pa.array(np.diff(ends)), "n_fallback": pa.array(fallback), "round_trip": pa.array(same)}
                yield pa.RecordBatch.from_arrays([made[f.name].cast(f.type) if f.name in made else part.column(f.name).cast(f.type) for f in schema], schema=schema)

    return work


def encode(docs: DataFrame, model_file: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Returns the columns ``keep`` (by default all but the text) with the ids of the text.

    Adds ``ids``, ``n_ids``, ``n_fallback`` (ids that stand for single bytes) and ``round_trip``
    (whether decoding gives the text back; U+2581 in a text comes back as a space).  Null and
    empty texts have no ids.  Columns named like the results give way.  ``model_file`` is a path on the driver; the model, of fixed size,
    is broadcast.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    with open(model_file, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    hidden = Hidden(docs)
    kept = hidden.columns(keep)
    shown = hidden.df.select(*kept, F.col(hidden(text)).alias("_text"))
    schema = with_fields(shown.select(*kept).schema, "ids array<int>, n_ids long, n_fallback long, round_trip boolean")
    out = shown.mapInArrow(_encode(model_file, model, to_arrow_schema(schema)), schema)
    return hidden.restore(out, "ids", "n_ids", "n_fallback", "round_trip", names=keep)


def decode(rows: DataFrame, model_file: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """Adds the text of a column of ids, which takes the place of a column so called.

    Null lists give null and empty ones the empty text.  Null ids, and numbers that are no id of
    the model, decode like the unknown piece; bytes that are no UTF-8 give U+FFFD.
    """
    with open(model_file, "rb") as file:
        model = rows.sparkSession.sparkContext.broadcast(file.read())

    @F.arrow_udf("string")
    def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = _transducer(model_file, model)
        for batch in batches:
            texts = []
            for value in batch:
                if value.is_valid:
                    known = value.values.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
                    texts.append(machine.decode(np.where((known >= 0) & (known < len(machine.texts)), known, machine.unknown)))
                else:
                    texts.append(None)
            yield pa.array(texts, type=pa.string())

    return rows.withColumn(to, text_of(ids))
