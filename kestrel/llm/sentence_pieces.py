"""SentencePiece encoding, decoding, and sampling of segmentations without replacement.

Sampling works on the lattice of all segmentations of a text into pieces of the
model. A piece's probability falls with its rank as Zipf's law has it. The
total mass to the right of every place gives the probability of each next
piece, so a segmentation is a path of such choices. Gumbel top-k: the text's
best path gets a Gumbel score; all that deviates from it, anywhere, is a region
with a Gumbel score of its own, truncated at the path's. The search always opens
the region with the highest score, as A* does: it draws the place and the piece
of the deviation by their masses, then the rest of the path, and is left with
what deviates from that path and with the region without it. The k paths found
are distinct, and a sample of k without replacement. Random numbers are seeded
by the row's key.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.tables import read, small
from kestrel.llm.terms import mix

SPACE = "▁"

#: Unknown characters are spelt in bytes, each written as one of these characters.
BYTES = 0x10FF00

STEP = np.uint64(0x9E3779B97F4A7C15)

#: Words that a worker keeps, of those that two batches hold; the others are forgotten once their lattices have so many transitions.
CACHE, TRANSITIONS = 110_000, 8_000_000

#: Mass under which a long word's masses are raised, by its inverse, before they vanish.
FAINT = 1e-100

#: Words whose lattices are built together; words that are encoded as one text.
AT_ONCE, JOINED = 20_000, 4096

#: Words of printable Latin-1 that no normalization can give a space; only such are encoded together.
SIMPLE = re.compile(r"[!-~¡-§©-«®°-³µ-·¹-ÿ]+")


@dataclass(frozen=True)
class Sampling:
    """Parameters: segmentations of a text, sharpness of the pieces' distribution, seed."""

    k: int = 3
    sharpness: float = 1.0
    seed: int = 11


_made: dict = {}


class Pieces:
    """The model's pieces, and the lattices of words seen so far, in flat arrays.

    A state is a place in a word; its transitions are the pieces that may come
    next, likeliest first, with their cumulated probabilities.
    """

    @classmethod
    def of(cls, path: str, sharpness: float) -> Pieces:
        if (path, sharpness) not in _made:
            _made[path, sharpness] = cls(path, sharpness)
        return _made[path, sharpness]

    def __init__(self, path: str, sharpness: float):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        size = m.get_piece_size()
        scores = np.array([m.get_score(i) for i in range(size)])
        rank = np.empty(size)
        rank[np.argsort(-scores, kind="stable")] = np.arange(size)
        weight = 1 / (rank + 2.7) ** sharpness
        self.weight = weight / weight.sum()
        texts: dict[str, int] = {}
        for i in range(size):
            if m.is_byte(i):
                texts[chr(BYTES + int(m.id_to_piece(i)[3:5], 16))] = i
                self.weight[i] = self.weight.min()
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                texts[m.id_to_piece(i)] = i
        self.unknown = re.compile("[^" + "".join(re.escape(c) for c in texts if len(c) == 1 and c < chr(BYTES)) + "]")
        spelt = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) else m.id_to_piece(i).replace(SPACE, " ").encode() for i in range(size)]
        self.opens = np.array([m.id_to_piece(i)[:1] == SPACE for i in range(size)])
        self.spelt_count = np.array([len(x) for x in spelt])
        self.spelt_begin, self.spelt = np.cumsum(self.spelt_count) - self.spelt_count, np.frombuffer(b"".join(spelt), np.uint8)
        self.plain = not self.unknown.search("".join(map(chr, range(33, 127))))
        self.tables = []  # for each length: sorted hashes of what begins a piece, and the piece that it is, or -1
        longest = max(map(len, texts))
        for length in range(1, longest + 1):
            own = sorted({c[:length] for c in texts if len(c) >= length})
            hashes = np.zeros(len(own), np.uint64)
            for at in range(length):
                hashes = hashes * STEP + np.array([ord(c[at]) for c in own], np.uint64)
            order = np.argsort(hashes)
            self.tables.append((hashes[order], np.array([texts.get(c, -1) for c in own], np.int32)[order]))
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = Flat(np.int32)
        self.begin, self.cum, self.logs = Flat(np.int32), Flat(np.float32), Flat(np.float32)
        self.next, self.piece = Flat(np.int32), Flat(np.int32)
        self.id_begin, self.id_count = Flat(np.int64), Flat(np.int64)
        #: Of each word: whether its ids spell it, with a space before it.
        self.same = Flat(np.bool_)
        #: Of each run, which is a word: its first state, and its main path, which takes the likeliest transition everywhere.
        self.run_state, self.main_begin, self.main_count, self.main = Flat(np.int64), Flat(np.int64), Flat(np.int64), Flat(np.int32)
        #: Of each state: the chance to leave the main path from there on. Of each transition: log of the chance of another.
        self.slack, self.rest = Flat(np.float64), Flat(np.float32)
        #: Sizes of all the arrays where the kept words end, and the words learnt since.
        self.kept = [x.size for x in self._flats()]
        self.others: list[str] = []

    def _flats(self) -> list[Flat]:
        return [x for x in vars(self).values() if isinstance(x, Flat)]

    def forget(self, words: set[str]) -> None:
        """Makes room: of the words that aren't kept, those of this batch are, up to a bound; the rest goes."""
        others, self.others = self.others, []
        for word in others:
            del self.index[word]
        for flat, size in zip(self._flats(), self.kept, strict=True):
            flat.size = size
        if self.cum.size > TRANSITIONS // 2:  # long words
            self.clear()
        again = [w for w in others if w in words][:max(0, CACHE - len(self.index))]
        for at in range(0, len(again), AT_ONCE):
            self.learn(again[at:at + AT_ONCE])
        self.kept, self.others = [x.size for x in self._flats()], []

    def _spelt(self, word: str) -> str:
        return self.unknown.sub(lambda c: "".join(chr(BYTES + b) for b in c[0].encode("utf-8", "surrogatepass")), word)

    def _lattices(self, runs: list[str]) -> None:
        """Adds the states and transitions of runs of symbols, all runs at once."""
        codes = np.frombuffer(("\0".join(runs) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(codes)
        ends = np.flatnonzero(codes == 0)
        end = ends[np.searchsorted(ends, np.arange(n))]
        alive, hashes = np.flatnonzero(codes), np.zeros(n, np.uint64)[:len(np.flatnonzero(codes))]
        starts, lengths, found = [], [], []
        for length, (table, ids) in enumerate(self.tables, 1):
            keep = alive + length <= end[alive]
            alive, hashes = alive[keep], hashes[keep]
            if not len(alive):
                break
            hashes = hashes * STEP + codes[alive + length - 1]
            at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
            keep = table[at] == hashes
            alive, hashes, at = alive[keep], hashes[keep], at[keep]
            hit = np.flatnonzero(ids[at] >= 0)
            starts.append(alive[hit]), lengths.append(np.full(len(hit), length)), found.append(ids[at[hit]])
        start, length, piece = np.concatenate(starts), np.concatenate(lengths), np.concatenate(found)
        mass = np.zeros(n)
        mass[ends] = 1.0
        p = self.weight[piece]
        widest, longest = max(map(len, runs)), len(self.tables)
        narrow = np.uint8 if widest < 1 << 8 else np.uint16 if widest < 1 << 16 else np.int64
        left = (end[start] - start).astype(narrow)
        order = np.argsort(left, kind="stable")
        bounds = np.searchsorted(left[order], np.arange(widest + 2))
        for d in range(1, widest + 1):  # the last symbols of all runs first
            own = order[bounds[d]:bounds[d + 1]]
            p[own] *= mass[start[own] + length[own]]
            np.add.at(mass, start[own], p[own])
            p[own] /= mass[start[own]]
            faint = np.unique(start[own][mass[start[own]] < FAINT])
            if len(faint):  # only the ratios of the places that a piece can reach matter
                reach = faint[:, None] + np.arange(longest + 1)
                mass[reach[reach <= end[faint][:, None]]] /= FAINT
        order = np.argsort(start + (1 - p) / 2, kind="stable")
        start, length, piece, p = start[order], length[order], piece[order], p[order]
        count = np.bincount(start, minlength=n)
        begin = np.cumsum(count) - count
        total = np.cumsum(p)
        cum = total - np.concatenate([[0.0], total])[begin[start]]
        last = begin[count > 0] + count[count > 0] - 1
        cum[last] = 1.0
        p[begin[count == 1]] = 1.0
        base, edge = self.begin.size, self.cum.size
        others = np.maximum(total[last][np.cumsum(count > 0)[start] - 1] - np.concatenate([[0.0], total])[begin[start]] - p, 0)
        others[begin[count == 1]] = 0.0
        following = start + length
        slack = np.zeros(n)
        inner = np.flatnonzero(count)
        left = (end[inner] - inner).astype(narrow)
        order = np.argsort(left, kind="stable")
        bounds = np.searchsorted(left[order], np.arange(widest + 2))
        for d in range(1, widest + 1):
            own = inner[order[bounds[d]:bounds[d + 1]]]
            first = begin[own]
            slack[own] = others[first] + p[first] * slack[following[first]]
        state, live, steps = np.concatenate([[0], ends[:-1] + 1]), np.arange(len(ends)), []
        while len(live):
            took = begin[state]
            steps.append((live, took))
            state = following[took]
            on = count[state] > 0
            live, state = live[on], state[on]
        sizes = np.bincount(np.concatenate([live for live, _ in steps]), minlength=len(ends))
        at = np.cumsum(sizes) - sizes
        main = np.zeros(int(sizes.sum()), np.int64)
        for i, (live, took) in enumerate(steps):
            main[at[live] + i] = took
        self.main_begin.add(self.main.size + at), self.main_count.add(sizes), self.main.add(edge + main)
        self.run_state.add(base + np.concatenate([[0], ends[:-1] + 1]))
        self.slack.add(slack)
        with np.errstate(divide="ignore"):
            self.rest.add(np.log(others))
        self.begin.add(edge + begin)
        self.cum.add(np.minimum(cum, 1.0)), self.logs.add(np.log(p)), self.piece.add(piece)
        self.next.add(base + following)

    def learn(self, words: list[str]) -> None:
        """Encodes new words and builds their lattices."""
        simple, other, ids, sizes = [], [], [], []
        for w in words:
            (simple if SIMPLE.fullmatch(w) else other).append(w)
        for at in range(0, len(simple), JOINED):
            part = simple[at:at + JOINED]
            ids.append(np.array(self.model.encode(" ".join(part), num_threads=1), np.int32))
            sizes.append(np.diff(np.flatnonzero(np.append(self.opens[ids[-1]], True))))
            if len(sizes[-1]) != len(part):
                raise AssertionError("a word is not one run of pieces")
        for w, got in zip(other, self.model.encode(other, num_threads=1) if other else [], strict=True):
            ids.append(np.array(got if w else [self.model.piece_to_id(SPACE)], np.int32))  # "" is a space that ends a text
            sizes.append(np.array([len(ids[-1])]))
        words = simple + other
        spelt = [SPACE + (w if self.plain and w.isascii() and w.isprintable() else self._spelt(w)) for w in words]
        sizes = np.concatenate(sizes)
        self.id_begin.add(self.ids.size + np.cumsum(sizes) - sizes)
        self.id_count.add(sizes)
        self.ids.add(np.concatenate(ids))
        self.same.add(self._spells(words, np.concatenate(ids), sizes))
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words)), strict=True))
        self.others += words
        self._lattices(spelt)

    def _spells(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether each word, which has so many of the ids, is what they spell."""
        want = np.frombuffer("".join([" " + w for w in words]).encode("utf-8", "surrogatepass"), np.uint8)
        first = np.flatnonzero(want == ord(" "))  # words hold none
        counts = self.spelt_count[ids]
        got = spread(self.spelt, self.spelt_begin[ids], counts)
        edges = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(sizes)])]
        wide, long = np.diff(np.append(first, len(want))), np.diff(edges)
        same = wide == long
        alike = np.flatnonzero(same)
        differing = spread(want, first[alike], wide[alike]) != spread(got, edges[alike], long[alike])
        same[alike[np.searchsorted(np.cumsum(wide[alike]), np.flatnonzero(differing), side="right")]] = False
        return same

    @staticmethod
    def even(text: str) -> bool:
        """Whether single spaces split a text into its words."""
        return text != "" and not ("  " in text or text[0] == " " or text[-1] == " ")

    @staticmethod
    def split(text: str) -> list[str] | None:
        """Words whose encodings, each with the space before it, add up to the text's; None where the spaces split it."""
        if Pieces.even(text):
            return None
        return [w[1:] for w in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))] if text else []

    def know(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of the words of each text, new words being learnt."""
        split = [self.split(t) for t in texts]
        even = [i for i, words in enumerate(split) if words is None]
        cut = pc.split_pattern(pa.array([texts[i] for i in even], pa.large_string()), " ")
        numbered = pc.dictionary_encode(cut.flatten())
        words = numbered.dictionary.to_pylist()
        odd = set().union(*[w for w in split if w])
        if self.cum.size >= TRANSITIONS:
            self.forget(odd.union(words))
        known = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(known < 0)
        new = [words[i] for i in missing]
        new += odd.difference(self.index, new)
        for at in range(0, len(new), AT_ONCE):
            self.learn(new[at:at + AT_ONCE])
        known[missing] = [self.index[w] for w in new[:len(missing)]]
        known = known[numbered.indices.to_numpy()]
        ends = cut.offsets.to_numpy()
        out = [np.array([self.index[w] for w in words or ()], np.int64) for words in split]
        for i, a, b in zip(even, ends, ends[1:], strict=False):
            out[i] = known[a:b]
        return out

    def decoded(self, ids: np.ndarray) -> bytes:
        """The text that ids spell: their pieces in a row, without the space that the model puts first."""
        got = spread(self.spelt, self.spelt_begin[ids], self.spelt_count[ids]).tobytes()
        return got[1:] if got[:1] == b" " else got

    def returns(self, text: str, words: np.ndarray, ids: np.ndarray) -> bool:
        """Whether decoding a text's ids gives the text back: by its words, and only where that doesn't tell by the text."""
        return bool(self.even(text) and self.same.a[words].all()) or self.decoded(ids) == text.encode("utf-8")

    def encoded(self, words: np.ndarray) -> np.ndarray:
        """The model's ids of a text."""
        return spread(self.ids.a, self.id_begin.a[words], self.id_count.a[words])

    def draw(self, runs: np.ndarray, seeds: np.ndarray, heads: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Transitions, in order, of paths through ``runs``, and each one's place in ``runs``.

        Every run has a seed of its own, so runs of many texts can be drawn at
        once. Where ``heads`` holds a state (not -1), the run is drawn from there
        on. Most runs take their main path; of the others, those steps are drawn
        that leave it.
        """
        n = len(runs)
        begin, cum, logs, following, slack = self.begin.closed(self.cum.size), self.cum.a, self.logs.a, self.next.a, self.slack.a

        def goes_on(state: np.ndarray) -> np.ndarray:
            return begin[state] < begin[state + 1]

        state = self.run_state.a[runs]
        counts = self.main_count.a[runs].copy()
        leaves = uniforms(seeds, 0) < slack[state]
        bound = np.ones(n, bool)  # still on the main path, which the run must leave
        if heads is not None:
            given = heads >= 0
            leaves |= given
            bound &= ~given
            state = np.where(given, heads, state)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        live = np.flatnonzero(leaves)
        counts[live] = 0
        live = live[goes_on(state[live])]
        state, bound, seeds = state[live], bound[live], seeds[live]
        while len(live):
            took = begin[state].astype(np.int64)
            pick, turn = uniforms(seeds, 2 * len(steps) + 1), uniforms(seeds, 2 * len(steps) + 2)
            first = cum[took].astype(np.float64)
            stay = bound & (turn * slack[state] < np.exp(logs[took].astype(np.float64)) * slack[following[took]])
            aim = np.where(bound, np.where(stay, 0.0, first + pick * (1 - first)), pick)
            bound = bound & stay
            more = np.flatnonzero((cum[took] <= aim) & ~stay)
            while len(more):
                took[more] += 1
                more = more[cum[took[more]] <= aim[more]]
            steps.append((live, took))
            counts[live] += 1
            state = following[took].astype(np.int64)
            on = goes_on(state)
            live, state, bound, seeds = live[on], state[on], bound[on], seeds[on]
        ends = np.cumsum(counts)
        at = ends - counts
        owner = np.repeat(np.arange(n), counts)
        out = self.main.a[np.minimum((self.main_begin.a[runs] - at)[owner] + np.arange(len(owner)), self.main.size - 1)]
        for i, (live, took) in enumerate(steps):
            out[at[live] + i] = took
        return out, owner

    def beside(self, edge: int, taken: list[int]) -> np.ndarray:
        """The transitions of the state that ``edge`` leaves, but for ``taken`` ones."""
        begin = self.begin.a[:self.begin.size]
        state = int(np.searchsorted(begin, begin.dtype.type(edge), side="right")) - 1
        after = begin[state + 1] if state + 1 < len(begin) else self.cum.size
        return np.array([e for e in range(begin[state], after) if e not in taken], np.int64)


class Flat:
    """A growing array: ``a`` holds ``size`` values and room for more."""

    def __init__(self, kind):
        self.a, self.size = np.zeros(1 << 12, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.size + len(more) > len(self.a):
            grown = np.zeros(max(self.size + len(more), len(self.a) * 3 // 2), self.a.dtype)
            grown[:self.size] = self.a[:self.size]
            self.a = grown
        self.a[self.size:self.size + len(more)] = more
        self.size += len(more)

    def closed(self, end) -> np.ndarray:
        """The values and, past them, ``end``."""
        self.add(np.array([end], self.a.dtype))
        self.size -= 1
        return self.a


def spread(flat: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` in a row."""
    ends = np.cumsum(counts)
    if not len(ends):
        return flat[:0]
    return flat[np.repeat(begins - ends + counts, counts) + np.arange(ends[-1])]


def uniforms(seeds: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) from 64-bit seeds."""
    return (mix(seeds + np.uint64(salt * int(STEP) & (1 << 64) - 1)) >> np.uint64(11)) * 2.0**-53


def gumbel(uniform: float, mass: float, below: float) -> float:
    """Gumbel score of a region of this mass, truncated at ``below``."""
    if mass <= 0.0:
        return -math.inf
    return -math.log(math.exp(-below) - math.log1p(-uniform) / max(mass, 1e-300) + 1e-300)


class Region:
    """All paths that follow ``path`` up to some place from ``first`` on and leave it there, but for those taken out."""

    def __init__(self, path: np.ndarray, word: np.ndarray, logs: np.ndarray, rest: np.ndarray, first: int, score: float, uniform: float):
        self.path, self.word, self.first = path, word, first  # word: of each place
        self.before = logs.cumsum() - logs
        self.masses = np.exp(self.before[first:] + rest[first:])
        self.taken: dict[int, list[int]] = {}
        self.measure(score, uniform)

    def measure(self, below: float, uniform: float) -> None:
        self.sums = self.masses.cumsum()
        self.score = gumbel(uniform, float(self.sums[-1]) if len(self.sums) else 0.0, below)

    def turn(self, pieces: Pieces, where: float, which: float, uniform: float) -> tuple[int, int, float]:
        """Takes a deviation out of the region: its place, its transition, and the score that it had."""
        i = min(int(np.searchsorted(self.sums, where * self.sums[-1], side="right")), len(self.sums) - 1)
        while not self.masses[i]:
            i -= 1
        place = self.first + i
        taken = self.taken.setdefault(place, [int(self.path[place])])
        left = pieces.beside(int(self.path[place]), taken)
        odds = np.exp(pieces.logs.a[left].astype(np.float64))
        at = min(int(np.searchsorted(odds.cumsum(), which * odds.sum(), side="right")), len(left) - 1)
        taken.append(int(left[at]))
        self.masses[i] = math.exp(self.before[place]) * (odds.sum() - odds[at]) if len(left) > 1 else 0.0
        score = self.score
        self.measure(score, uniform)
        return place, int(left[at]), score


class Search:
    """The search for one text's best perturbed paths: its regions by their scores."""

    def __init__(self, pieces: Pieces, runs: np.ndarray, key: np.uint64, dice: list[float]):
        self.pieces, self.runs, self.key, self.dice = pieces, runs, key, dice
        self.regions: list[Region] = []
        self.found: list[tuple[np.ndarray, float]] = []
        self.opened: tuple | None = None

    def seeds(self, own: int = 0) -> np.ndarray:
        """Seeds of the runs from ``own`` on for the next path."""
        return mix(self.key + (np.arange(own, len(self.runs), dtype=np.uint64) << np.uint64(16)) + np.uint64(len(self.found)))

    def add(self, path: np.ndarray, word: np.ndarray) -> None:
        """Takes a path (what follows the deviation, where there is one), and the region beside it."""
        first, score = 0, -math.log(-math.log1p(-self.dice[0]) + 1e-300)
        if self.opened:
            best, place, turn, own, score = self.opened
            first = place + 1
            path, word = np.concatenate([best.path[:place], [turn], path]), np.concatenate([best.word[:place], [own], word + own])
        logs = self.pieces.logs.a[path].astype(np.float64)
        self.found.append((path, float(logs.sum())))
        self.regions.append(Region(path, word, logs, self.pieces.rest.a[path].astype(np.float64), first, score, self.dice[1]))

    @property
    def score(self) -> float:
        """Of the best region left."""
        return max(r.score for r in self.regions)

    def split(self, dice: list[float]) -> tuple[np.ndarray, np.ndarray, int]:
        """Opens the best region: the runs to draw, their seeds, and the first one's state."""
        best = max(self.regions, key=lambda r: r.score)
        self.dice = dice
        place, turn, score = best.turn(self.pieces, *self.dice[2:5])
        own = int(best.word[place])
        self.opened = (best, place, turn, own, score)
        return self.runs[own:], self.seeds(own), int(self.pieces.next.a[turn])


def sample(pieces: Pieces, texts: list[np.ndarray], keys: list[np.uint64], k: int) -> list[tuple[list[tuple[np.ndarray, float]], float]]:
    """For each text (its words' numbers): the k best perturbed paths with their log probabilities, and the next score.

    The texts' searches go side by side, so that a round's paths are drawn at once.
    """
    def dice(keys: list[np.uint64], salt: int) -> list[list[float]]:
        return uniforms(np.array(keys, np.uint64)[:, None] + np.arange(8, dtype=np.uint64) * np.uint64(65537), salt).tolist()

    every = [Search(pieces, runs, key, own) for runs, key, own in zip(texts, keys, dice(keys, 7), strict=True)]
    jobs = [(s, s.runs, s.seeds(), -1) for s in every]
    for number in range(k):
        if number:
            open_ = [s for s in every if s.score > -np.inf]  # each has found ``number`` paths
            jobs = [(s, *s.split(own)) for s, own in zip(open_, dice([s.key for s in open_], 1000 + number), strict=True)]
        if not jobs:
            break
        sizes = np.array([len(runs) for _, runs, _, _ in jobs])
        ends = np.cumsum(sizes)
        heads = np.full(int(ends[-1]), -1, np.int64)
        heads[ends - sizes] = [head for *_, head in jobs]
        paths, owners = pieces.draw(np.concatenate([runs for _, runs, _, _ in jobs]), np.concatenate([x for _, _, x, _ in jobs]), heads if number else None)
        cuts = np.searchsorted(owners, np.concatenate([[0], ends]))
        for (s, *_), a, b, offset in zip(jobs, cuts, cuts[1:], ends - sizes, strict=False):
            s.add(paths[a:b], owners[a:b] - offset)
    return [(s.found, s.score) for s in every]


def key_of(key, seed: int) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(f"{key}", seed))


def log_inclusion(log_prob: float, after: float) -> float:
    """Log of the chance that a path's perturbed score exceeds ``after``."""
    apart = log_prob - after
    return apart if apart < -30 else float(np.log(-np.expm1(-np.exp(min(apart, 50.0)))))


SCHEMA = "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean, samples array<struct<rank:int,n_pieces:long,ids_crc32:long,log_prob:double,log_inclusion:double>>"


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of every text; a null text gives null."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces.of(path, 1.0).model
        for batch in small(batches):
            ids = [None if t is None else model.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encoded, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with ``ids``, of the model's encoding or of a sampled one; null gives null."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces.of(path, 1.0).model
        for batch in small(batches):
            texts = [None if i is None else model.decode(i) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(decoded, "doc_id long, text string")


def segmentations(text: str, key, pieces: Pieces, s: Sampling = Sampling()) -> list[tuple[list[int], float]]:
    """Ids and log probability of each sampled segmentation of one text."""
    [words] = pieces.know([text])
    if not len(words):
        return []
    [(paths, _)] = sample(pieces, [words], [key_of(key, s.seed)], s.k)
    return [(pieces.piece.a[path].tolist(), log_prob) for path, log_prob in paths]


def sample_segmentations(docs: DataFrame, path: str, s: Sampling = Sampling()) -> DataFrame:
    """Encoding and sampled segmentations of every text of ``docs``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. A null
    text counts as empty: no tokens, no samples. A text with fewer than k
    segmentations gives all it has. Rows with one doc_id and one text get the
    same samples. ``log_inclusion`` is the log of the chance that a sample of k
    holds that segmentation, given the score of the first one left out.
    ``round_trip`` tells whether decoding the text's ids gives the text back.
    """

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(path, s.sharpness)
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        for batch in small(batches, 4 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            split = pieces.know(texts)
            ids = batch.column(0).to_pylist()
            full = [i for i, words in enumerate(split) if len(words)]
            drawn = dict(zip(full, sample(pieces, [split[i] for i in full], [key_of(ids[i], s.seed) for i in full], s.k), strict=True))
            for i, words in enumerate(split):
                own, samples = pieces.encoded(words), []
                paths, after = drawn.get(i, ([], 0.0))
                for rank, (taken, log_prob) in enumerate(paths, 1):
                    samples.append({"rank": rank, "n_pieces": len(taken), "ids_crc32": crc(pieces.piece.a[taken]), "log_prob": log_prob, "log_inclusion": log_inclusion(log_prob, after)})
                rows.append((ids[i], len(own), crc(own), pieces.returns(texts[i], words, own), samples))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sampled, SCHEMA)


TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.struct([("rank", pa.int32()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("log_prob", pa.float64()), ("log_inclusion", pa.float64())]))]


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return sample_segmentations(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
