"""Language identification by cross-parsing: which language's text covers a document in fewest phrases.

For each language a suffix automaton holds whole texts of a bounded sample of labelled rows.  A
document is parsed greedily, from its first letter to its last and across blanks, into the longest
matches that the automaton knows; the number of phrases, divided by the number of letters,
estimates the cross-entropy of the document relative to the language.  The language that needs
fewest normalised phrases wins.

The automata of all languages lie in one array.  Documents are cut into pieces, and all pieces of
a batch are parsed side by side, one character at a time; a piece whose parse began elsewhere than
that of the whole document is followed phrase by phrase until both meet, so the count is exactly
that of one parse from the first letter to the last.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.llm.common import Hidden, held

#: Bounds on what is learned from: rows of each language, the length in characters up to which rows
#: are preferred (longer ones serve where a language has too few, the shortest first), and the
#: characters of all languages together.
SAMPLE_ROWS, SAMPLE_LENGTH, SAMPLE_WHOLE = 24, 8000, 1_000_000
#: Parts in which a language's rows are ranked first.
PARTS = 64
#: Characters of a piece, and characters that are parsed together.
PIECE, TOGETHER = 4096, 1 << 22


def suffix_automaton(text: Sequence[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        now = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = now
            p = link[p]
        if p != -1:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return moves


def letter_runs(codes: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """Code points with every run of what is no letter made one blank (0), one at either end."""
    codes = np.concatenate([[0], np.where(letter[codes], codes, 0), [0]])
    blank = codes == 0
    return codes[~blank | np.concatenate([[True], ~blank[:-1]])]


def letters() -> np.ndarray:
    """Which code points are letters (categories L*)."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")


class Automata:
    """The automata of several languages in one array.

    A state is a number b; its transition by symbol c is at b + c of ``table``, which holds the
    state it belongs to and the one it leads to.  Symbol 0 is the blank, and the last one stands
    for letters that no language knows and for the ends of documents: nothing leads on by it.
    """

    def __init__(self, texts: dict[str, list[str]]) -> None:
        self.languages = sorted(texts)
        letter = letters()
        streams = [letter_runs(np.concatenate([np.concatenate([code_points(t), [0]]) for t in texts[k]]).astype(np.int64), letter) for k in self.languages]
        self.alphabet = np.unique(np.concatenate([*streams, [0]]))
        self.roots, owner, symbol, target = [], [], [], []
        states = 0
        for stream in streams:
            moves = suffix_automaton(np.searchsorted(self.alphabet, stream).tolist())
            degree = np.array([len(m) for m in moves])
            self.roots.append(states)
            owner.append(states + np.repeat(np.arange(len(moves)), degree))
            symbol.append(np.fromiter((c for m in moves for c in m), dtype=np.int64, count=int(degree.sum())))
            target.append(states + np.fromiter((t for m in moves for t in m.values()), dtype=np.int64, count=int(degree.sum())))
            states += len(moves)
        if states:
            self._place(states, *map(np.concatenate, (owner, symbol, target)))

    def _place(self, states: int, owner: np.ndarray, symbol: np.ndarray, target: np.ndarray) -> None:
        """Gives every state a number so that no two transitions share a place: random tries, crowded states first."""
        rng = np.random.Generator(np.random.PCG64(10))
        size = 2 * (len(owner) + states) + len(self.alphabet)
        number, used, taken = np.full(states, -1), np.zeros(size + len(self.alphabet) + 1, dtype=bool), np.zeros(size, dtype=bool)
        degree = np.bincount(owner, minlength=states)
        for low, high in ((8, None), (2, 8), (0, 2)):
            left = np.flatnonzero((degree >= low) & (degree < (high or len(self.alphabet) + 1)))
            while len(left):
                tried = np.full(states, -1)
                tried[left] = rng.integers(0, size, len(left))
                # A number is had by one state, and a place by one transition.
                _, first = np.unique(tried[left], return_index=True)
                good = np.zeros(states, dtype=bool)
                good[left[first]] = ~taken[tried[left[first]]]
                mine = np.flatnonzero(good[owner])
                place = tried[owner[mine]] + symbol[mine]
                clash = used[place]
                _, first = np.unique(place, return_index=True)
                clash[np.setdiff1d(np.arange(len(place)), first)] = True
                good[owner[mine[clash]]] = False
                new = np.flatnonzero(good)
                number[new] = tried[new]
                taken[tried[new]] = True
                used[place[good[owner[mine]]]] = True
                left = left[~good[left]]
        table = np.full(len(used), -1, dtype=np.int64)
        table[number[owner] + symbol] = number[owner] << 32 | number[target]
        self.table, self.roots = table, number[self.roots]


class Parser:
    """Counts phrases of texts by the automata."""

    def __init__(self, automata: Automata) -> None:
        self.automata, self.letter = automata, letters()
        self.unknown = len(automata.alphabet)
        # Letters of all languages, and one more.
        symbols = np.full(0x110000, self.unknown, dtype=np.uint16 if self.unknown < 1 << 16 else np.uint32)
        symbols[automata.alphabet] = np.arange(self.unknown)
        self.symbols = symbols

    def counts(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Letters of each text, and its phrases by language."""
        n = np.zeros(len(texts), dtype=np.int64)
        phrases = np.zeros((len(texts), len(self.automata.languages)), dtype=np.int64)
        group: list[tuple[int, np.ndarray]] = []
        size = 0
        for i, text in enumerate(texts):
            stream = letter_runs(code_points(text or ""), self.letter)
            n[i] = np.count_nonzero(stream)
            if n[i] and len(self.automata.languages):
                group.append((i, self.symbols[stream]))
                size += len(stream)
            if group and (size >= TOGETHER or i + 1 == len(texts)):
                phrases[[i for i, _ in group]] = self._parse([s for _, s in group])
                group, size = [], 0
        if group:
            phrases[[i for i, _ in group]] = self._parse([s for _, s in group])
        return n, phrases

    def _parse(self, streams: list[np.ndarray]) -> np.ndarray:
        """Phrases of each stream by language."""
        end = np.array([self.unknown], dtype=self.symbols.dtype)
        data = np.concatenate([x for s in streams for x in (s, end)])
        length = np.array([len(s) for s in streams])
        begin = np.cumsum(length + 1) - length - 1
        pieces = -(-length // PIECE)
        doc = np.repeat(np.arange(len(streams)), pieces)
        start = begin[doc] + PIECE * (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        stop = np.minimum(start + PIECE, (begin + length)[doc])
        out = np.zeros((len(streams), len(self.automata.languages)), dtype=np.int64)
        single = pieces == 1
        for k, root in enumerate(self.automata.roots.tolist()):
            lane, at = self._run(data, start, stop, root)
            found = np.bincount(lane, minlength=len(start))
            out[doc, k] = found
            for d in np.flatnonzero(~single).tolist():
                first = int(pieces[:d].sum())
                out[d, k] = self._joined(data, start, stop, lane, at, found, range(first, first + int(pieces[d])), root)
        return out

    def _run(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray, root: int) -> tuple[np.ndarray, np.ndarray]:
        """Parses from each start until a phrase ends at or after its stop: (lane, end) of every phrase, in order."""
        table = self.automata.table
        lane, at, node = np.arange(len(start)), start.copy(), np.full(len(start), root)
        stop = stop.copy()
        lanes, ends = [], []
        while len(lane):
            step = table[node + data[at]]
            failed = np.flatnonzero((step >> 32) != node)
            node, before = step & 0xFFFFFFFF, node
            at += 1
            if len(failed):
                # What the automaton does not know ends a phrase, or is one if it comes first.
                at[failed] -= before[failed] != root
                node[failed] = root
                lanes.append(lane[failed])
                ends.append(at[failed])
                done = failed[ends[-1] >= stop[failed]]
                if len(done):
                    left = np.ones(len(lane), dtype=bool)
                    left[done] = False
                    lane, at, node, stop = lane[left], at[left], node[left], stop[left]
        lane, at = np.concatenate(lanes), np.concatenate(ends)
        order = np.argsort(lane, kind="stable")
        return lane[order], at[order]

    def _joined(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray, lane: np.ndarray, at: np.ndarray, found: np.ndarray, mine: range, root: int) -> int:
        """Phrases of one stream out of those of its pieces."""
        table, count, here = self.automata.table, 0, int(start[mine[0]])
        for k in mine:
            low = int(np.searchsorted(lane, k))
            ends = at[low : low + int(found[k])]
            while here < stop[k]:
                known = int(np.searchsorted(ends, here, "right"))
                if here == start[k] or (known and ends[known - 1] == here):
                    count += len(ends) - known
                    here = int(ends[-1])
                    break
                node, begin = root, here
                while (step := int(table[node + int(data[here])])) >> 32 == node:
                    node, here = step & 0xFFFFFFFF, here + 1
                here = max(here, begin + 1)
                count += 1
        return count

    def judge(self, texts: Sequence[str | None]) -> tuple[list[str], list[float]]:
        """Languages, and confidences: by what part a text's phrases are fewer than the runner-up's."""
        n, phrases = self.counts(texts)
        names, scores = [], []
        for letters_, row in zip(n.tolist(), phrases, strict=True):
            if not letters_ or not len(row):
                names.append("und")
                scores.append(0.0)
                continue
            order = np.argsort(row, kind="stable")
            names.append(self.automata.languages[order[0]])
            scores.append(float(1 - row[order[0]] / row[order[1]]) if len(order) > 1 else 1.0)
        return names, scores


def samples(rows: DataFrame) -> dict[str, list[str]]:
    """Whole texts of a bounded sample of labelled rows for each language.

    ``rows`` has text ``t`` and language ``l``.  Equal texts count once.  Of the distinct texts of
    a language those of up to SAMPLE_LENGTH characters come first, in a pseudorandom order of
    their own.  Each language has an equal part of SAMPLE_WHOLE characters, and takes SAMPLE_ROWS
    of its rows or as many whole ones as that part holds, one at least: so every language is
    learned, and what reaches the driver is bounded.  Ranks are found in PARTS parts of a language
    and then among the first of each, so no language is one task's.
    """
    size = F.length("t")
    labelled = rows.filter("l is not null and t is not null").select("l", "t", F.xxhash64("t").alias("k"), F.when(size > SAMPLE_LENGTH, size).otherwise(0).alias("long"), size.alias("size"))
    part = Window.partitionBy("l", F.pmod("k", F.lit(PARTS))).orderBy("long", "k")
    whole = Window.partitionBy("l").orderBy("long", "k")
    chosen = labelled.groupBy("l", "k", "long", "size").agg(F.lit(1).alias("one")).drop("one")
    for window in (part, whole):
        chosen = chosen.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= SAMPLE_ROWS)
    languages = labelled.select("l").distinct().count()
    upto = F.sum("size").over(whole.rowsBetween(Window.unboundedPreceding, 0))
    chosen = chosen.withColumn("upto", upto).filter((F.col("rank") == 1) | (F.col("upto") <= SAMPLE_WHOLE // max(1, languages)))
    # SAMPLE_ROWS rows for each language at most.
    chosen = F.broadcast(chosen.select("l", "k"))
    picked = labelled.join(chosen, ["l", "k"]).groupBy("l", "k").agg(F.min("t").alias("t"))
    out: dict[str, list[str]] = {}
    for row in picked.orderBy("l", "k").toLocalIterator():
        out.setdefault(row.l, []).append(row.t)
    return out


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", learn: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """Returns the columns ``keep`` (by default all) with ``lang_pred`` and ``score``.

    Learns from rows where ``learn`` holds (by default all) and ``lang`` is not null; whole texts
    are judged, by nothing but the text.  A text that is null or has no letter is ``und`` with
    score 0, and so is everything if nothing was learned.  ``score`` is 1 - best/second of the
    normalised phrase counts, 1 if only one language was learned; ties go to the language first
    in code point order.  Repeated rows are judged alike; a very long text is one row's work,
    parsed in pieces; an empty table gives no rows.  Columns named like the results give way.
    """
    spark = docs.sparkSession
    rows = docs.filter(learn) if learn is not None else docs
    hidden = Hidden(docs)
    automata = Automata(samples(Hidden(rows).df.select(F.col(hidden(text)).alias("t"), F.col(hidden(lang)).alias("l"))))
    model = spark.sparkContext.broadcast(automata)
    stamp = hash((tuple(automata.languages), automata.table.tobytes() if automata.languages else b""))

    @F.arrow_udf("lang_pred string, score double")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parser = held(("languages", stamp), lambda: Parser(model.value))
        for batch in batches:
            found = [parser.judge(batch.slice(k, 1024).to_pylist()) for k in range(0, len(batch), 1024)]
            names, scores = ([x for part in found for x in part[i]] for i in (0, 1))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    keep = list(docs.columns) if keep is None else keep
    # Only the texts go to Python; the other columns stay where they are.
    shown = hidden.df.select(*hidden.columns(keep), judged.asNondeterministic()(hidden(text)).alias("_judged"))
    return hidden.restore(shown.select("*", "_judged.lang_pred", "_judged.score"), "lang_pred", "score", names=keep)
