"""Language identification by cross-parsing entropy.

Per language, a suffix automaton of labelled text answers "how far does this text go on as something seen in that
language"; parsing a text greedily into such longest matches, a language that fits needs few, long phrases.  With a
training text of N symbols a phrase costs about log2(N) bits, so `phrases * log2(N) / symbols` estimates the cross
entropy, comparable between languages with training texts of different length; the smallest wins.

Only the fit uses a sample, of whole texts: at most `DOCS_PER_LANGUAGE` labelled rows a language, those of smallest hash, texts
of more than `LONG_TEXT` characters only where a language has too few others.  The automata are built once, on the driver, and
go to the workers as lists of edges; there all rows of transitions share one array, so their size is that of the sample, however
many symbols a script has.

Every text is scored whole, in numpy: texts are cut into pieces of `CHUNK` symbols that take each step together, each from the
start state; then every piece is walked again from the state its predecessor ended in until it meets the walk it has (two walks
that are in one state agree from there on), and so on until no end changes.  The phrases are those of one walk over the text.

Cases: null, empty and letterless texts give `und` with score 0; languages never seen in training cannot be predicted; a tie goes to
the smaller language name; with no labelled row every text is `und`; a null doc_id, repeated rows, extra columns and an empty table
change nothing: each row is judged by its text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ._cluster import quoted
from ._columnar import lean

DOCS_PER_LANGUAGE = 32
LONG_TEXT = 4096
PARTS = 32
CHUNK = 768
SLICE_CHARS = 1_500_000
BEGUN = np.int32(1 << 30)


def training_sample(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs_per_language: int = DOCS_PER_LANGUAGE) -> dict[str, list[str]]:
    """The whole texts of at most `docs_per_language` rows a language; the texts that go on are ranked before they move."""
    h = F.xxhash64(F.col(key).cast("string"), F.col(text), F.lit(17))
    letters = F.col(text).rlike(r"\p{L}")
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & letters).select(F.col(lang).cast("string").alias("l"), F.struct((F.length(text) > LONG_TEXT).alias("long"), h.alias("h")).alias("h"), F.col(text).alias("x"))
    # Without their texts, and first within a part of each language, so that the last ranking sees PARTS * docs_per_language rows a language at most.
    first = rows.select("l", "h").withColumn("r", F.row_number().over(Window.partitionBy("l", F.pmod("h.h", F.lit(PARTS))).orderBy("h"))).where(F.col("r") <= docs_per_language)
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("r") <= docs_per_language)
    chosen = sorted({r.h for r in ranked.select("h.h").collect()})  # bounded by the limit times the number of languages
    out: dict[str, list[tuple]] = {}
    for row in rows.where(F.col("h.h").isin(chosen)).select("l", "h", "x").distinct().collect() if chosen else []:
        out.setdefault(row.l, []).append((tuple(row.h), row.x))
    return {k: [x for _, x in sorted(v)[:docs_per_language]] for k, v in out.items()}


class Symbols:
    """Letters as small numbers: 0 a run of other characters, 1 a letter not seen in training, 2.. the letters seen."""

    def __init__(self, texts: list[str]):
        seen = sorted({c for t in texts for c in t.lower() if c.isalpha() and ord(c) < 65536})
        self.table = np.zeros(65537, np.int32)
        self.table[65536] = 1
        self.letters = np.zeros(65537, bool)
        for i in range(65536):
            if not 0xD800 <= i < 0xE000 and chr(i).isalpha():
                self.table[i], self.letters[i] = 1, True
        self.letters[65536] = True
        for i, c in enumerate(seen):
            self.table[ord(c)] = i + 2
        self.n = len(seen) + 2

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts, their offsets, and whether each has a letter."""
        lowered = [t.lower() for t in texts]
        lengths = np.fromiter((len(t) for t in lowered), np.int64, len(lowered))
        code = np.minimum(np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32), 65536)
        sym = self.table[code]
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        keep = np.ones(len(sym), bool)
        keep[1:] = (sym[1:] != 0) | (sym[:-1] != 0)
        count = np.concatenate([[0], np.cumsum(keep)])
        letter = np.concatenate([[0], np.cumsum(self.letters[code])])
        return sym[keep], count[bounds], letter[bounds[1:]] > letter[bounds[:-1]]


def automaton(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (state, symbol, next state) of the suffix automaton; 0 is the start."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    state = np.repeat(np.arange(len(nxt), dtype=np.int32), [len(row) for row in nxt])
    return state, np.array([c for row in nxt for c in row], np.int32), np.array([t for row in nxt for t in row.values()], np.int32)


class Walker:
    """Steps of many walks at once: the next state, marked BEGUN where the symbol begins a phrase (every one does at the start).

    All states' rows lie in one array, each shifted so that no two edges meet (those of many edges placed first, by trying places; a row that
    finds none gets one at the end); an entry names its state.
    """

    def __init__(self, state: np.ndarray, symbol: np.ndarray, to: np.ndarray, n_symbols: int, states: int):
        self.first = np.full(n_symbols, BEGUN, np.int32)
        self.first[symbol[state == 0]] = to[state == 0] | BEGUN
        symbol, to, state = symbol[state > 0], to[state > 0], state[state > 0]
        edges = np.bincount(state, minlength=states)
        size = 3 * len(state) + 64
        self.shift = np.zeros(states, np.int32)
        self.entry = np.full(size + n_symbols, -1, np.int64)
        owner = np.full(len(self.entry), -1, np.int64)
        r = np.random.default_rng(1)
        for bits in range(int(edges.max(initial=0)).bit_length(), 0, -1):
            todo, tries = np.flatnonzero(edges[state] >> (bits - 1) == 1), 0
            while len(todo):
                own, tries = np.unique(state[todo]), tries + 1
                if tries <= 50:
                    self.shift[own] = r.integers(0, size, len(own))
                else:
                    self.shift[own] = len(owner) + np.arange(len(own)) * n_symbols
                    more = np.full(len(own) * n_symbols, -1, np.int64)
                    owner, self.entry = np.concatenate([owner, more]), np.concatenate([self.entry, more])
                at = self.shift[state[todo]] + symbol[todo]
                free = owner[at] < 0
                owner[at[free]] = state[todo[free]]  # of those that want one place the last gets it
                lost = np.zeros(states, bool)
                lost[state[todo[owner[at] != state[todo]]]] = True
                again = lost[state[todo]]
                back = at[again & (owner[at] == state[todo])]
                owner[back] = -1
                kept = ~again
                self.entry[at[kept]] = state[todo[kept]].astype(np.int64) << 32 | to[todo[kept]]
                todo = todo[again]

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        got = self.entry[self.shift[state] + symbol]
        return np.where(got >> 32 == state, got.astype(np.int32), self.first[symbol])


class CrossParser:
    """Automata of all languages, from the bounded training texts."""

    def __init__(self, sample: dict[str, list[str]]):
        self.languages = sorted(sample)
        self.symbols = Symbols([t for v in sample.values() for t in v])
        self.edges, self.bits = [], []
        for name in self.languages:
            text, _, _ = self.symbols.encode([" ".join(sample[name])])
            self.edges.append(automaton(text))
            self.bits.append(np.log2(max(len(text), 2)))
        self._walkers: list[Walker] = []

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_walkers": []}

    @property
    def walkers(self) -> list[Walker]:
        """Made where they are used."""
        if not self._walkers:
            self._walkers = [Walker(*e, self.symbols.n, int(e[2].max(initial=0)) + 1) for e in self.edges]
        return self._walkers

    def phrases(self, sym: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each text in each language (documents x languages)."""
        lengths = np.diff(offsets)
        pieces = -(-lengths // CHUNK)
        doc = np.repeat(np.arange(len(lengths)), pieces)
        order = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = offsets[doc] + order * CHUNK
        size = np.minimum(offsets[doc + 1] - start, CHUNK)
        by = np.argsort(-size, kind="stable")  # longer pieces first: those still running are a prefix
        out = np.zeros((len(lengths), len(self.languages)))
        if not len(doc):
            return out
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        after = np.where(np.append(doc[1:], -1) == doc, np.append(place[1:], -1), -1)[by]  # the piece that goes on where this one ends
        start, size, doc = start[by], size[by], doc[by]
        running = np.searchsorted(-size, -np.arange(int(size[0])), "left")
        columns = [sym[start[:n] + i] for i, n in enumerate(running)]
        for k, walker in enumerate(self.walkers):
            state = np.zeros(len(doc), np.int32)
            walk = []
            for c in columns:
                t = walker.step(state[: len(c)], c)
                walk.append(t)
                state[: len(c)] = t & (BEGUN - 1)
            ended = np.flatnonzero(after >= 0)
            while len(ended):
                came = np.argsort(after[ended])
                at, now = after[ended][came], state[ended][came]
                changed = []
                for c, w in zip(columns, walk):
                    over = np.searchsorted(at, len(c))  # those from here on have no more symbols: their ends are new
                    changed.append(at[over:])
                    state[at[over:]] = now[over:]
                    at, now = at[:over], now[:over]
                    t = walker.step(now, c[at])
                    now = t & (BEGUN - 1)
                    other = now != (w[at] & (BEGUN - 1))
                    w[at] = t
                    at, now = at[other], now[other]
                    if not len(at):
                        break
                state[at] = now
                ended = np.concatenate([*changed, at])
                ended = ended[after[ended] >= 0]
            begun = np.zeros(len(doc), np.int32)
            for t in walk:
                begun[: len(t)] += t >> 30
            out[:, k] = np.bincount(doc, begun, len(lengths))
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        sym, offsets, letter = self.symbols.encode(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        rate = self.phrases(sym, offsets) * np.array(self.bits) / np.maximum(np.diff(offsets), 1)[:, None]
        best = rate.argmin(1)
        low = rate[np.arange(len(texts)), best]
        weight = np.exp2(-4.0 * (rate - low[:, None]))
        score = np.where(letter, 1.0 / weight.sum(1), 0.0)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, letter)], score


def identify(docs: DataFrame, sample: dict[str, list[str]], key: str = "doc_id", text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """`keep` columns (the key by default) with prediction and score, called `names`; score is the winner's share of 2**(-4 bits)."""
    columns = [key] if keep is None else keep
    rows = docs.select(*map(quoted, columns), *([] if text in columns else [quoted(text)]))
    schema = StructType([*(f for f in rows.schema if f.name in columns), StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    parser = CrossParser(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            found, scores, a = [], [], 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b]) <= SLICE_CHARS):
                    size += len(texts[b])
                    b += 1
                got = parser.predict(texts[a:b])
                found += got[0]
                scores.append(got[1])
                a = b
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(found, pa.string()), pa.array(np.concatenate([*scores, []]), pa.float64())], [*columns, *names])

    return rows.mapInArrow(lean(run), schema)
