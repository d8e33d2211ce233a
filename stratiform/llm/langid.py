"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is cut greedily into
phrases, each the longest match in the automaton; the language that needs the fewest phrases,
normalised by the size of its training text, wins (ties: the smaller name).

Only the automaton's transitions are needed for greedy parsing. Those of all languages lie in one array of
displaced rows (a state's transition by symbol c stands at base[state] + c), so the table grows with the transitions, whatever the
alphabet, and a slice of texts is parsed with one look-up for each position of all blocks at once. A block is first parsed as if a phrase
began with it. Then the phrase that really runs into it is followed until it ends where the first parse ended one too, as from there
both agree; so phrases cross block ends and their number is that of one parse of the whole text. Letters are lower-cased, anything else is one space.

Null texts and texts without a letter give `und` and score 0. Texts of any length are parsed whole, a repeated row is predicted each time.
Without training rows every prediction is `und`, and an empty table gives an empty result. Other columns, whatever their names, may be kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, fold, give_back, named, slices, unused

PER_LANGUAGE, MIN_CHARS, MAX_CHARS, TRAIN_SYMBOLS, BLOCK = 24, 200, 4_000, 30_000, 1024
SPACE, OTHER = 1, 2
LANES = 4096  # blocks parsed at once


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state; state 0 is the root."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
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
            if length[p] + 1 == length[q]:
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
    return nxt


def displaced(states: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base of each state, and to and owner of each place: transition c of a state s is at base[s] + c if owner there is s, else there is none.

    States with several transitions are set first, most first, each where they fit; those with one fill the places that are left.
    """
    base = np.zeros(len(states), np.int32)
    taken = bytearray(width + 2 * sum(map(len, states)))
    low, end = width, width
    for s in sorted((i for i, t in enumerate(states) if len(t) > 1), key=lambda i: (-len(states[i]), i)):
        symbols = sorted(states[s])
        while taken[low]:
            low += 1
        for b in range(low - symbols[0], low - symbols[0] + 64):
            if not any(taken[b + c] for c in symbols):
                break
        else:
            b = end - symbols[0]
        top = b + symbols[-1] + 1
        if top + width > len(taken):
            taken.extend(bytes(len(taken)))
        for c in symbols:
            taken[b + c] = 1
        base[s], end = b, max(end, top)
    single = [i for i, t in enumerate(states) if len(t) == 1]
    free = np.flatnonzero(np.frombuffer(bytes(taken), np.uint8)[width:] == 0) + width
    if len(free) < len(single):
        free = np.concatenate([free, np.arange(len(taken), len(taken) + len(single))])
    for s, at in zip(single, free.tolist(), strict=False):
        base[s] = at - next(iter(states[s]))
        end = max(end, at + 1)
    to, owner = np.zeros(end + width, np.int32), np.full(end + width, -1, np.int32)
    for s, t in enumerate(states):
        for c, x in t.items():
            to[base[s] + c], owner[base[s] + c] = x, s
    return base, to, owner


class CrossParser:
    """fit() on (language, text) rows, then predict() on texts."""

    def fit(self, rows: list[tuple[str, str]], train_symbols: int = TRAIN_SYMBOLS) -> CrossParser:
        self.languages = sorted({lang for lang, _ in rows})
        letters = sorted({c for _, t in rows for c in t.lower() if c.isalpha()})
        self.kind = np.uint16 if OTHER + 1 + len(letters) < 1 << 16 else np.uint32
        self.code = np.array([OTHER if chr(cp).isalpha() else SPACE for cp in range(0x110000)], self.kind)
        for i, c in enumerate(letters):
            self.code[ord(c)] = OTHER + 1 + i
        self.width = OTHER + 1 + len(letters)
        states: list[dict[int, int]] = [{}]  # state 0 takes no symbol
        self.roots, self.cost = [], []
        for lang in self.languages:
            symbols = self.symbols(" ".join(t for of, t in rows if of == lang))[0][:train_symbols]
            first = len(states)
            states += [{c: first + x for c, x in t.items()} for t in suffix_automaton(symbols.tolist())]
            self.roots.append(first)
            self.cost.append(np.log2(max(2, len(symbols))))
        self.base, self.to, self.owner = displaced(states, self.width)
        return self

    def symbols(self, text: str) -> tuple[np.ndarray, bool]:
        """Symbol numbers with runs of spaces made one; whether there is a letter."""
        s = self.code[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        if not len(s):
            return s, False
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != SPACE) | (s[:-1] != SPACE)
        return s[keep], bool((s > SPACE).any())

    def _step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Next states, 0 where there is no transition."""
        at = self.base[state] + c
        return np.where(self.owner[at] == state, self.to[at], 0)

    def phrases(self, parts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        out = np.zeros((len(parts), len(self.languages)))
        size = np.array([len(p) for p in parts], np.int64)
        blocks = np.cumsum(np.maximum(1, -(-size // BLOCK)))
        begin = 0
        while begin < len(parts):
            done = blocks[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(blocks, done + LANES, side="right")))
            out[begin:end] = self._phrases(parts[begin:end])
            begin = end
        return out

    def _phrases(self, parts: list[np.ndarray]) -> np.ndarray:
        size = np.array([len(p) for p in parts], np.int64)
        blocks = np.maximum(1, -(-size // BLOCK))
        owner = np.repeat(np.arange(len(parts)), blocks)
        lanes = np.zeros((len(owner), BLOCK), self.kind)
        flat = np.concatenate(parts)
        first = np.cumsum(blocks) - blocks
        lanes.ravel()[np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first * BLOCK, size)] = flat
        used = np.full(len(owner), BLOCK, np.int64)
        used[first + blocks - 1] = size - (blocks - 1) * BLOCK
        order = np.argsort(-used, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        previous = np.full(len(order), -1)  # the lane of the block before, in sorted order
        later = np.flatnonzero(np.concatenate([[False], owner[1:] == owner[:-1]]))
        previous[place[later]] = place[later - 1]
        lanes, used, owner = np.ascontiguousarray(lanes[order].T), used[order], owner[order]
        live = np.searchsorted(-used, -np.arange(BLOCK), side="left")  # lanes longer than each position
        out = np.zeros((len(parts), len(self.languages)))
        for j, root in enumerate(self.roots):
            at_root = self._step(np.full(self.width, root), np.arange(self.width))
            begins = np.zeros(lanes.shape, bool)
            state = np.zeros(len(owner), np.int32)
            for i in range(BLOCK):
                n = live[i]
                if not n:
                    break
                c = lanes[i, :n]
                to = self._step(state[:n], c)
                begins[i, :n] = miss = to == 0
                state[:n] = np.where(miss, at_root[c], to)
            count = begins.sum(0)
            alone, total, last = count.copy(), count.copy(), state.copy()
            wave = np.flatnonzero(previous >= 0)
            while len(wave):
                n, end, met = self._follow(lanes, used, begins, alone, wave, last[previous[wave]], at_root)
                total[wave] = n
                end = np.where(met, state[wave], end)
                changed = wave[end != last[wave]]
                last[wave] = end
                wave = np.flatnonzero(np.isin(previous, changed) & (previous >= 0)) if len(changed) else changed
            np.add.at(out[:, j], owner, total)
        return out

    def _follow(self, lanes: np.ndarray, used: np.ndarray, begins: np.ndarray, alone: np.ndarray, which: np.ndarray, state: np.ndarray, at_root: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the lanes `which`, entered in `state`: phrases that begin in the block, the state at its end, and whether the parse met the block's own."""
        n, end, met = np.zeros(len(which), np.int64), state.copy(), np.zeros(len(which), bool)
        at, mine, own = np.arange(len(which)), np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
        state = state.copy()
        for i in range(BLOCK):
            over = used[which[at]] <= i
            if over.any():
                n[at[over]], end[at[over]] = mine[over], state[over]
                at, mine, own, state = at[~over], mine[~over], own[~over], state[~over]
            if not len(at):
                return n, end, met
            c = lanes[i, which[at]]
            to = self._step(state, c)
            miss, theirs = to == 0, begins[i, which[at]]
            mine, own = mine + miss, own + theirs
            state = np.where(miss, at_root[c], to)
            both = miss & theirs
            if both.any():
                n[at[both]] = mine[both] + alone[which[at[both]]] - own[both]
                met[at[both]] = True
                at, mine, own, state = at[~both], mine[~both], own[~both], state[~both]
        n[at], end[at] = mine, state
        return n, end, met

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        pairs = [self.symbols(t or "") for t in texts]
        known = np.array([x[1] for x in pairs], bool) & bool(self.languages)
        names, score = ["und"] * len(texts), np.zeros(len(texts))
        where = np.flatnonzero(known)
        if len(where):
            parts = [pairs[i][0] for i in where]
            h = self.phrases(parts) * np.array(self.cost) / np.array([len(p) for p in parts])[:, None]
            best = h.argmin(1)
            e = np.exp(-3 * (h - h.min(1, keepdims=True)))
            score[where] = e[np.arange(len(where)), best] / e.sum(1)
            for i, b in zip(where, best, strict=True):
                names[i] = self.languages[b]
        return names, score


def train(documents: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", mod: int = 4, out: int = 2) -> CrossParser:
    """Learns from PER_LANGUAGE documents a language, of MIN_CHARS to MAX_CHARS characters where there are such.

    Each hash bucket of a language gives its document of such a length with the smallest key hash (of a repeated key the smallest text), or
    where none has it that of any length; of a longer text the first MAX_CHARS characters are learned, which bounds what the driver gets.
    """
    base = documents.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (fold(F.col(key), mod) != out))
    src = base.select(F.col(lang).cast("string").alias("_l"), F.col(text).alias("_t"), F.xxhash64(F.col(key).cast("string")).alias("_h"), F.length(text).between(MIN_CHARS, MAX_CHARS).alias("_fits"))
    best = src.groupBy("_l", F.pmod("_h", F.lit(PER_LANGUAGE)).alias("_b")).agg(F.min(F.when(F.col("_fits"), F.col("_h"))).alias("_fit"), F.min("_h").alias("_any"))
    best = best.select("_l", F.coalesce("_fit", "_any").alias("_h"), F.col("_fit").isNotNull().alias("_only"))
    # PER_LANGUAGE rows for each language label: bounded
    found = src.join(F.broadcast(best), ["_l", "_h"]).where(F.col("_fits") | ~F.col("_only"))
    got = found.groupBy("_l", "_h").agg(F.min(F.left("_t", F.lit(MAX_CHARS))).alias("_t")).collect()
    return CrossParser().fit([(lg, t) for lg, _, t in sorted(tuple(r) for r in got)])


def identify(documents: DataFrame, model: CrossParser, *, text: str = "text", keep: list[str]) -> DataFrame:
    """`keep` columns of every row, then lang_pred and score."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kept = documents.select(*named(*keep))
    at = unused(keep, "_text")

    def run(batches):
        for b in batches:
            for s in slices(b, at, 3 << 20):
                names, score = shared.value.predict(s.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*(s.column(k) for k in keep), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])
        give_back()

    return documents.select(*named(*keep), F.col(text).alias(at)).mapInArrow(run, ddl(kept, "lang_pred string", "score double"))
