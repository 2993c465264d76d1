"""Benchmark decontamination: latent semantic retrieval of benchmark passages in documents, then longest common subsequences and answer checks.

The benchmark is worked on in blocks of ITEMS items; a block's passages (items cut into at most PASSAGE words) and all that is made from them is small and goes to every task.
BLOCKS blocks share each pass over the documents: one pass counts, one sketches, one searches. For a block:

1. Terms are the words of its passages. Their document frequencies are counted over all runs of PASSAGE words of all documents; terms in over MAX_DF of them weigh nothing, but each
   passage's RAREST terms always weigh.
2. Randomised SVD (Halko et al., 2011) of the TF-IDF rows of all those runs and of the block's passages, which are weighted so that both parts have equal energy: tasks add up
   A'(A G) for a Gaussian matrix G, and the driver orthonormalises the sum. The columns span the latent space, which has one dimension for SHARE passages.
3. Windows of WINDOW words, a new one every STEP words, so that each passage lies whole in one, are projected into it; a passage whose cosine is COSINE or more of what
   the space keeps of the passage's own square length is a candidate: a window's cosine to a passage shrinks by as much in the space, but for chance.
   The RAREST terms of a common passage (one of them is in over MAX_DF of the runs) weigh too little beside rarer words of a window. Common passages are candidates without a
   weight: where a window of WINDOW + STEP words, which any stretch of step 4 lies whole in, has as many of the passage's terms as PARAPHRASE of its words can't do without.
4. A candidate is a leak if the longest common subsequence of the passage and a stretch of the text of at most 1.25 times its length (and two words) has COPY of the passage's words,
   or PARAPHRASE of them while the text around has the answer word for word. The answer is the item's own, where a column gives it, else the passage's last quarter (three words or more).

Words are runs of ASCII letters, digits and other characters, in lower case; ASCII marks and blanks part them. Nothing but sums is shuffled; a document's decisions are made where its text is.

Cases: null text is empty and holds no leak; items of under FEWEST words have nothing to retrieve: they are found where their words stand side by side in the same order (kind copy, no
cosine); items without words, without a text or without an id are never found; null doc_ids and equal rows each come out; very long texts are searched whole; items with equal texts are
all found, and of equally good stretches for an item the first one counts; an empty table or an empty benchmark gives no leaks; other columns are kept as they are, but one of the leaks' name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import NOT_ALNUM, Scratch, byte_classes, hash_words, slices, spare, text_bytes, word_rows

#: Items of a block, and blocks of a pass.
ITEMS, BLOCKS = 1024, 4
PASSAGE, WINDOW, STEP, FEWEST = 48, 64, 16, 5
#: Terms in a larger share of the runs weigh nothing, but for each passage's RAREST ones.
MAX_DF, RAREST = 0.02, 8
#: Passages for each dimension of the latent space, and the fewest and most dimensions.
SHARE, LEAST_RANK, MOST_RANK = 3, 24, 192
COSINE = 0.3
COPY, PARAPHRASE = 0.8, 0.6
LEAK = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("lcs", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("kind", T.StringType())])
_LEAK = pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.int32()), ("n_words", pa.int32()), ("kind", pa.string())])
_CLASSES = byte_classes(NOT_ALNUM)
_SLOTS = 1 << 18
#: Rows of the sketch that travel together, and groups of tasks whose rows are added up first.
_ROWS, _SLOTS_A_PART = 256, 64


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and the number of each text's first word."""
    data, offsets = text_bytes(pc.utf8_lower(pc.fill_null(texts, "")))
    starts, _, words = hash_words(data, offsets, _CLASSES)
    return words, word_rows(starts, offsets)


def segment_sums(x: np.ndarray, index: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of x[index[first[i]:first[i + 1]]] for each i. Segments are added up side by side, longest first, so that each step adds whole rows."""
    size = np.diff(np.append(first, len(index)))
    order = np.argsort(-size, kind="stable")
    start, size = first[order], size[order]
    out = np.zeros((len(first), x.shape[1]), x.dtype)
    open_ = len(first)
    for i in range(int(size[0]) if len(size) else 0):
        while size[open_ - 1] <= i:
            open_ = int(np.searchsorted(-size, -i, side="left"))
        out[:open_] += np.take(x, index[start[:open_] + i], axis=0)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return out[back]


class Terms:
    """Numbers of known words."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.maybe = np.zeros(_SLOTS, bool)
        self.maybe[(self.hashes % np.uint64(_SLOTS)).astype(np.int64)] = True

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and numbers of the known ones."""
        at = np.flatnonzero(self.maybe[(words % np.uint64(_SLOTS)).astype(np.int64)])
        n = np.minimum(np.searchsorted(self.hashes, words[at]), len(self.hashes) - 1)
        known = self.hashes[n] == words[at]
        return at[known], n[known]


class Block:
    """A block's passages, their terms, weights and latent space."""

    def __init__(self, items: list[tuple[int, str, str | None]]):
        self.items, self.passages, self.answers = [], [], []
        self.short: dict[int, dict[tuple, list[int]]] = {}  # by number of words, the items of each run of words
        for item_id, text, answer in items:
            words = words_of(pa.array([text]))[0]
            if 0 < len(words) < FEWEST:
                self.short.setdefault(len(words), {}).setdefault(tuple(words.tolist()), []).append(item_id)
            parts = max(1, -(-len(words) // PASSAGE))
            for part in np.array_split(words, parts):
                if len(part) >= FEWEST:
                    own = words_of(pa.array([answer]))[0] if answer else part[-max(3, len(part) // 4) :]
                    self.items.append(item_id)
                    self.passages.append(part)
                    self.answers.append(own)
        self.terms = Terms(np.concatenate(self.passages)) if self.passages else None
        self.rank = min(MOST_RANK, max(LEAST_RANK, len(self.passages) // SHARE), len(self.terms.hashes) if self.terms else 0)
        self.own: dict[int, tuple[np.ndarray, np.ndarray, list[int]]] = {}  # of passages that were compared: words, their counts, their places
        self.set_common([])

    def set_common(self, passages: list[int], n: np.ndarray | None = None) -> None:
        """Of common passages: their numbers, the terms of each, and how many of them a leak has at least. The terms in most runs (n) are left out, for half of what a leak needs."""
        self.common = np.array(passages, np.int64)
        self.has = np.zeros((len(self.terms.hashes) if self.terms else 0, len(passages)), np.int8)
        self.needs = np.zeros(len(passages), np.int8)
        for i, p in enumerate(passages):
            own, size = np.unique(self.terms.find(self.passages[p])[1]), len(self.passages[p])
            need = max(1, len(own) - size + int(np.ceil(PARAPHRASE * size)))
            own = own[np.argsort(n[own], kind="stable")][: len(own) - need // 2]
            self.has[own, i], self.needs[i] = 1, need - need // 2

    def rows(self, term: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of occurrences of terms, by row, those that weigh; and the length of each row's TF-IDF vector."""
        some = self.idf[term] > 0
        term, row = term[some], row[some]
        both, count = np.unique(row.astype(np.int64) * len(self.idf) + term, return_counts=True)
        weight = count * self.idf[both % len(self.idf)]
        return term, row, np.sqrt(np.bincount(both // len(self.idf), weight * weight)) if len(row) else np.zeros(0)

    def sketch(self, sketch: np.ndarray, term: np.ndarray, row: np.ndarray, size: np.ndarray, scaled: np.ndarray) -> int:
        """Add A'(A G) of TF-IDF rows of length one to a sketch, but for the idf of its rows; scaled is G with its rows times idf. Returns the number of rows."""
        total = 0
        cuts = np.flatnonzero(np.diff(row, prepend=-1))
        for i in range(0, len(cuts), 512):  # a few MB at a time
            a, b = cuts[i], cuts[i + 512] if i + 512 < len(cuts) else len(row)
            first = cuts[i : i + 512] - a
            y = segment_sums(scaled, term[a:b], first)
            y /= (size[row[cuts[i : i + 512]]] ** 2)[:, None].astype(np.float32)
            order = np.argsort(term[a:b], kind="stable")
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, b - a)))
            terms = term[a:b][order]
            edges = np.flatnonzero(np.diff(terms, prepend=-1))
            sketch[terms[edges]] += segment_sums(y, of[order], edges)
            total += len(first)
        return total

    def gaussian(self) -> np.ndarray:
        """G with its rows times idf."""
        g = np.random.default_rng(7).standard_normal((len(self.idf), self.rank))
        return (g * self.idf[:, None]).astype(np.float32)

    def span(self, sketch: np.ndarray, n_rows: int) -> None:
        """The latent space from the documents' sketch, and the passages in it."""
        found = [self.terms.find(p)[1] for p in self.passages]
        term, row, size = self.rows(np.concatenate(found), np.repeat(np.arange(len(found)), [len(x) for x in found]))
        own = np.zeros_like(sketch)
        count = self.sketch(own, term, row, size, self.gaussian())
        basis, _ = np.linalg.qr((sketch + own * max(1.0, n_rows / max(1, count))).astype(np.float64) * self.idf[:, None])
        latent = np.zeros((len(self.passages), basis.shape[1]))
        np.add.at(latent, row, basis[term] * self.idf[term][:, None])
        self.basis = (basis * self.idf[:, None]).astype(np.float32)  # of a term's occurrence
        length = np.maximum(np.sqrt((latent * latent).sum(axis=1)), 1e-9)
        self.latent = np.ascontiguousarray((latent / length[:, None]).T.astype(np.float32))
        self.least = (COSINE * length / np.maximum(size, 1e-9)).astype(np.float32)

    def candidates(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(number of a window's first word, passage, cosine) over texts; windows begin every STEP words of a text."""
        steps = -(-np.diff(first) // STEP)
        base = np.concatenate([[0], np.cumsum(steps)])
        if not base[-1]:
            return
        at, term = self.terms.find(words)
        some = self.idf[term] > 0
        at, term = at[some], term[some]
        if not len(at):
            return
        text = np.searchsorted(first, at, side="right") - 1
        step = base[text] + (at - first[text]) // STEP
        steps_with, where = np.unique(step, return_index=True)
        sums = segment_sums(self.basis, term, where)
        wide = WINDOW // STEP
        text_of = np.repeat(np.arange(len(steps)), steps)
        # each step's terms belong to the windows that begin at it and up to wide - 1 steps before, in the same text
        window = (step[:, None] - np.arange(wide)).ravel()
        term, source = np.repeat(term, wide), np.repeat(step, wide)
        inside = (window >= 0) & (text_of[np.maximum(window, 0)] == text_of[source])
        both, count = np.unique(window[inside] * len(self.idf) + term[inside], return_counts=True)
        window, term = both // len(self.idf), both % len(self.idf)
        weight = count * self.idf[term]
        starts = np.flatnonzero(np.diff(window, prepend=-1))
        windows = window[starts]
        size = np.sqrt(np.add.reduceat(weight * weight, starts))
        for i in range(0, len(windows), 1024):
            part = windows[i : i + 1024]
            latent = np.zeros((len(part), sums.shape[1]), np.float32)
            for j in range(wide):
                s = np.minimum(part + j, base[-1] - 1)
                n = np.minimum(np.searchsorted(steps_with, s), len(steps_with) - 1)
                ok = (steps_with[n] == part + j) & (text_of[s] == text_of[part])
                latent[ok] += sums[n[ok]]
            cosine = (latent @ self.latent) / size[i : i + 1024, None]
            for w, p in zip(*np.nonzero(cosine >= self.least)):
                t = text_of[part[w]]
                yield int(first[t] + (part[w] - base[t]) * STEP), int(p), float(cosine[w, p])

    def common_candidates(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, None]]:
        """(number of a window's first word, common passage, None) where the window has the terms that a leak needs."""
        steps, wide, n_terms = -(-np.diff(first) // STEP), WINDOW // STEP + 1, len(self.has)
        base = np.concatenate([[0], np.cumsum(steps)])
        if not base[-1] or not len(self.common):
            return
        at, term = self.terms.find(words)
        some = self.has.any(axis=1)[term]
        at, term = at[some], term[some]
        text = np.searchsorted(first, at, side="right") - 1
        step, term = np.divmod(np.unique((base[text] + (at - first[text]) // STEP) * n_terms + term), n_terms)
        text_of = np.repeat(np.arange(len(steps)), steps)
        window = (step[:, None] - np.arange(wide)).ravel()
        term, source = np.repeat(term, wide), np.repeat(step, wide)
        inside = (window >= 0) & (text_of[np.maximum(window, 0)] == text_of[source])
        window, term = np.divmod(np.unique(window[inside] * n_terms + term[inside]), n_terms)
        starts = np.flatnonzero(np.diff(window, prepend=-1))
        ends = np.append(starts[1:], len(window))
        enough = ends - starts >= self.needs.min()
        starts, ends = starts[enough], ends[enough]
        for i in range(0, len(starts), 1024):
            a, b = starts[i : i + 1024], ends[i : i + 1024]
            begin = np.cumsum(b - a) - (b - a)
            index = np.repeat(a - begin, b - a) + np.arange(int((b - a).sum()))
            for w, p in zip(*np.nonzero(segment_sums(self.has, term[index], begin) >= self.needs)):
                x = window[a[w]]
                t = text_of[x]
                yield int(first[t] + (x - base[t]) * STEP), int(self.common[p]), None

    def cosine(self, words: np.ndarray, passage: int) -> float:
        """Of a window's words and a passage, in the latent space."""
        term = self.terms.find(words)[1]
        some, count = np.unique(term[self.idf[term] > 0], return_counts=True)
        size = np.sqrt(((count * self.idf[some]) ** 2).sum())
        return float((count @ self.basis[some]) @ self.latent[:, passage] / size) if len(some) else 0.0

    def leak(self, words: np.ndarray, a: int, b: int, passage: int) -> tuple[int, str] | None:
        """Longest common subsequence and kind, for a stretch in words[a:b]."""
        n = len(self.passages[passage])
        if passage not in self.own:
            own, of, count = np.unique(self.passages[passage], return_inverse=True, return_counts=True)
            masks = [0] * len(own)
            for i, w in enumerate(of.tolist()):
                masks[w] |= 1 << i
            self.own[passage] = own, count, masks
        own, count, masks = self.own[passage]
        part, need = words[a:b], PARAPHRASE * n
        word = np.minimum(np.searchsorted(own, part), len(own) - 1)
        at = np.flatnonzero(own[word] == part)
        word = word[at]
        # no subsequence has a word more often than the passage
        if len(at) < need or np.minimum(np.bincount(word, minlength=len(own)), count).sum() < need:
            return None
        found = [masks[w] for w in word.tolist()]
        ends = np.searchsorted(at, at + int(1.25 * n) + 2)
        full, best = (1 << n) - 1, 0
        starts = np.flatnonzero(ends - np.arange(len(ends)) >= need)
        for i, end in zip(starts.tolist(), ends[starts].tolist()):
            if end - i <= best:
                continue
            v = full  # Hyyro's bit-parallel recurrence; zeros of v count the subsequence
            for m in found[i:end]:
                u = v & m
                v = ((v + u) | (v - u)) & full
            best = max(best, n - v.bit_count())
        if best >= COPY * n:
            return best, "copy"
        if best >= PARAPHRASE * n:
            answer = self.answers[passage]
            k = len(answer)
            if 0 < k <= len(part) and (np.lib.stride_tricks.sliding_window_view(part, k) == answer).all(axis=1).any():
                return best, "paraphrase"
        return None

    def short_items(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, words) where an item of few words stands."""
        for n, runs in self.short.items():
            if len(words) < n:
                continue
            here = np.flatnonzero(np.isin(words[: len(words) - n + 1], np.array([x[0] for x in runs], np.uint64)))
            text = np.searchsorted(first, here, side="right") - 1
            here, text = here[here + n <= first[text + 1]], text[here + n <= first[text + 1]]
            for t, run in zip(text.tolist(), np.lib.stride_tricks.sliding_window_view(words, n)[here].tolist()):
                for item in runs.get(tuple(run), ()):
                    yield t, item, n

    def leaks(self, words: np.ndarray, first: np.ndarray) -> list[dict[int, dict]]:
        """Of each text, the best leak of each item."""
        out: list[dict] = [{} for _ in range(len(first) - 1)]
        for text, item, n in self.short_items(words, first):
            out[text][item] = {"item_id": item, "cosine": None, "lcs": n, "n_words": n, "kind": "copy"}
        if not self.passages:
            return out
        seen: set[tuple[int, int]] = set()
        for at, passage, cosine in chain(self.candidates(words, first), self.common_candidates(words, first)):
            if (at, passage) in seen:
                continue
            seen.add((at, passage))
            text = int(np.searchsorted(first, at, side="right")) - 1
            n = len(self.passages[passage])
            found = self.leak(words, max(int(first[text]), at - n), min(int(first[text + 1]), at + WINDOW + n), passage)
            if found:
                if cosine is None:
                    cosine = self.cosine(words[at : min(int(first[text + 1]), at + WINDOW)], passage)
                item = self.items[passage]
                new = {"item_id": item, "cosine": round(cosine, 4), "lcs": found[0], "n_words": n, "kind": found[1]}
                old = out[text].get(item)
                if old is None or (new["lcs"] / n, new["cosine"]) > (old["lcs"] / old["n_words"], old["cosine"] or 1.0):
                    out[text][item] = new
        return out


def _counts(blocks: list[Block]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, df = 0, [np.zeros(len(b.terms.hashes), np.int64) for b in blocks]
        for batch in slices(batches, "text", 1 << 19):
            words, first = words_of(batch.column("text"))
            runs, row = _runs(first)
            total += runs
            for block, n in zip(blocks, df):
                at, term = block.terms.find(words)
                n += np.bincount(np.unique(row[at] * len(n) + term) % len(n), minlength=len(n))
        for i, n in enumerate(df):
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some) + 1, i)), pa.array(np.append(some, -1)), pa.array(np.append(n[some], total))], ["block", "term", "n"])

    return run


def _runs(first: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of runs of PASSAGE words, and each word's run."""
    size = np.diff(first)
    runs = -(-size // PASSAGE)
    base = np.cumsum(runs) - runs
    text = np.repeat(np.arange(len(size)), size)
    return int(runs.sum()), base[text] + (np.arange(len(text)) - first[text]) // PASSAGE


_BODY = "block long, part long, n long, body binary"


def _sketch(blocks: list[Block]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaussian = [b.gaussian() for b in blocks]
        sketch, total = [np.zeros_like(g) for g in gaussian], [0] * len(blocks)
        for batch in slices(batches, "text", 1 << 19):
            words, first = words_of(batch.column("text"))
            _, row = _runs(first)
            for i, block in enumerate(blocks):
                at, term = block.terms.find(words)
                if len(at):
                    total[i] += block.sketch(sketch[i], *block.rows(term, row[at]), gaussian[i])
        slot = TaskContext.get().partitionId() % _SLOTS_A_PART
        for i, rows in enumerate(sketch):
            if total[i]:
                parts = range(0, len(rows), _ROWS)
                columns = [[i] * len(parts), list(range(len(parts))), [total[i]] * len(parts), [rows[k : k + _ROWS].tobytes() for k in parts], [slot] * len(parts)]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32()))], ["block", "part", "n", "body", "slot"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the bodies of each part; one body of each part is held."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    rows: dict[tuple[int, int], int] = {}
    for batch in batches:
        for block, part, n, body in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "n", "body"))):
            new, key = np.frombuffer(body, np.float32), (block, part)
            sums[key] = sums[key] + new if key in sums else new.astype(np.float64)
            rows[key] = rows.get(key, 0) + n
    columns = [[k[0] for k in sums], [k[1] for k in sums], list(rows.values())]
    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns), pa.array([x.astype(np.float32).tobytes() for x in sums.values()], pa.binary())], ["block", "part", "n", "body"])


def fit(documents: DataFrame, blocks: list[Block], scratch: Scratch) -> None:
    """Weights and latent spaces of blocks with passages, from all documents, in two passes. The driver gets one block's sketch at a time."""
    texts = documents.select(F.col("text").cast("string"))
    counted = texts.mapInArrow(_counts(blocks), "block long, term long, n long").groupBy("block", "term").agg(F.sum("n").alias("n")).toArrow()
    of, term_of, count = (counted[c].to_numpy() for c in ("block", "term", "n"))
    for b, block in enumerate(blocks):
        mine = of == b
        total = int(count[mine & (term_of < 0)].sum())
        n = np.zeros(len(block.terms.hashes))
        n[term_of[mine & (term_of >= 0)]] = count[mine & (term_of >= 0)]
        weighs = n <= MAX_DF * total
        common = []
        for i, (_, term) in enumerate(map(block.terms.find, block.passages)):
            term = np.unique(term)
            rarest = term[np.argsort(n[term], kind="stable")[:RAREST]]
            weighs[rarest] = True
            if n[rarest[-1]] > MAX_DF * total:
                common.append(i)
        block.set_common(common, n)
        block.idf = np.where(weighs, np.log((total + 2) / (n + 1)), 0.0)
    parts = sum(-(-len(b.idf) // _ROWS) for b in blocks)
    # added up in two steps, so that no task reads a body of every task
    added = texts.mapInArrow(_sketch(blocks), f"{_BODY}, slot int").repartition("block", "part", "slot").mapInArrow(_add, _BODY)
    added = scratch.write(added.repartition(min(parts, 64), "block", "part").mapInArrow(_add, _BODY), "sketch")
    for b, block in enumerate(blocks):
        got = added.where(F.col("block") == b).toArrow()
        sketch, rows = np.zeros((len(block.idf), block.rank), np.float32), 0
        for part, n, body in zip(*(got[c].to_pylist() for c in ("part", "n", "body"))):
            rows = n
            sketch[part * _ROWS : (part + 1) * _ROWS] = np.frombuffer(body, np.float32).reshape(-1, block.rank)
        block.span(sketch, rows)
    scratch.drop(added)


def with_leaks(documents: DataFrame, benchmark: DataFrame, answer: str | None = None, leaks: str = "leaks") -> DataFrame:
    """All columns (but one of the name of leaks, which is replaced), and the leaks in each document's text: array of item_id, cosine, lcs, n_words, kind.

    Three passes over the documents for ITEMS x BLOCKS items.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "leaks")
    known = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long"), F.col("text").cast("string"), (F.col(answer).cast("string") if answer else F.lit(None).cast("string")).alias("answer"))
    groups, blocks, held = [], [], []

    def close() -> None:
        nonlocal blocks
        some = [b for b in blocks if b.passages]
        if some:
            fit(documents, some, scratch)
        if blocks:
            groups.append(spark.sparkContext.broadcast(blocks))  # BLOCKS x ITEMS items and their terms, whatever the tables' size
        blocks = []

    for row in known.orderBy("item_id", "text").toLocalIterator():
        held.append(tuple(row))
        if len(held) == ITEMS:
            blocks, held = [*blocks, Block(held)], []
            if len(blocks) == BLOCKS:
                close()
    if held:
        blocks.append(Block(held))
    close()
    names = [c for c in documents.columns if c != leaks]
    out = documents.withColumn(leaks, F.lit(None).cast(T.ArrayType(LEAK)))
    for shared in groups:
        out = _annotate(out, shared, leaks)
    return out.select(*names, F.coalesce(leaks, F.array().cast(T.ArrayType(LEAK))).alias(leaks))


def _annotate(documents: DataFrame, shared, leaks: str) -> DataFrame:
    """Adds the leaks of some blocks."""
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            words, first = words_of(batch.column("text").cast(pa.string()))
            found = [[*(x or [])] for x in batch.column(leaks).to_pylist()]
            for block in shared.value:
                for text, of in enumerate(block.leaks(words, first)):
                    found[text] += sorted(of.values(), key=lambda y: y["item_id"])
            cols = [pa.array(found, pa.list_(_LEAK)) if c == leaks else batch.column(i) for i, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays(cols, names)

    return documents.mapInArrow(run, documents.schema)


def leaked_items(documents: DataFrame, benchmark: DataFrame, answer: str | None = None) -> DataFrame:
    """A row for each document and item that it leaks."""
    found = with_leaks(documents.select("doc_id", "text"), benchmark, answer)
    return found.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")


def without_leaks(documents: DataFrame, benchmark: DataFrame, answer: str | None = None) -> DataFrame:
    """The documents that leak no item, with their own columns."""
    found = spare(documents.columns, "leaks")
    return with_leaks(documents, benchmark, answer, found).where(F.size(found) == 0).select(*documents.columns)
