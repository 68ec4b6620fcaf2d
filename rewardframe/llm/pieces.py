"""SentencePiece encoding and decoding with sampled segmentations.

The vocabulary is read from a given SentencePiece model; nothing is trained. A text is prefixed by
one space, spaces become U+2581, and its lattice has an edge for every piece that matches; a
character that is no piece (U+2581 itself included) is one edge of byte pieces. A piece's log
probability falls with its rank (``ZIPF``: merge models hold ranks, not probabilities), and
``THETA`` sharpens or flattens the distribution over the lattice's paths.

Sampling without replacement is Gumbel top-k by a perturbed A* search. A node's bound is the
largest Gumbel of the paths below it, which backward sums over the lattice make exact. Following
the best edge from the root gives the first sample; at each edge on the way the remaining edges
together are one branch, whose bound is a Gumbel at its log mass truncated at the path's. The best
branch of all gives the next sample, and so on; the best branch left over is the threshold kappa,
and a sample's inclusion score is 1 - exp(-exp(log_prob - kappa)). Branches whose log mass is below
-``DEPTH`` are not drawn: the chance that one is ever chosen is less than a double can tell from 0.

No piece holds white space after another character, so the lattice is a chain of lattices of single
words: those are built once for each distinct word of a task, and the draws of all words of many
texts are made together. Draws are hashes of the row's key, the place in the text and the sample's
number, so a row gets the same samples wherever it is processed.

Defined results: a null or empty text has the one empty segmentation; a text with fewer distinct
segmentations than asked for has them all (kappa is then minus infinity and the score 1); words and
runs of spaces are whole, however long, and take memory in proportion; rows with equal keys and
texts get equal samples; tables may be empty.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
THETA = 0.3
ZIPF = 10.0
DEPTH = 40.0
#: Edges of a text that are searched for branches at first.
HEAD = 512
SEED = 4242
#: Characters before a word's end from which on its sums are held as logs, and draws of one place.
PLAIN_CHARS, DRAWS = 64, 512
SPACE = "▁"
#: Characters of text that are drawn together, and lattice cells kept for reuse.
CHUNK_CHARS = 1 << 19
KEPT_EDGES = 4_000_000
#: Log probabilities are whole multiples of 1 / GRAIN: their sums are exact, whatever else is summed.
GRAIN = 2.0**40
MAX_PIECE = 16


#: Stands for a U+2581 of the text itself: a lone surrogate, which no text holds.
ALIEN = "\udc81"
#: Of these, the characters that no longer piece of the vocabulary holds stand alone.
CONTROLS = "\n\r\t"


@dataclass(frozen=True)
class Vocabulary:
    """pieces by id; first_byte: id of the piece of byte 0; normal: whether an id is a plain piece."""

    pieces: list[str]
    normal: np.ndarray
    first_byte: int


def load(path: str = MODEL) -> Vocabulary:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    normal = [not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)) for i in ids]
    return Vocabulary([model.id_to_piece(i) for i in ids], np.array(normal), model.piece_to_id("<0x00>"))


def mix_bits(x: np.ndarray) -> np.ndarray:
    """Uniform draws in (0, 1) from 64-bit counters."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    for factor in (0xD6E8FEB86659FD93, 0xD6E8FEB86659FD93):
        x ^= x >> np.uint64(32)
        x *= np.uint64(factor)
    x >>= np.uint64(11)
    out = x.astype(np.float64)
    out += 0.5
    out *= 2.0**-53
    return out


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for lengths[0] values, then from starts[1], and so on."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class WordNumbers(dict):
    """Numbers of words in the order in which they are first asked for; ``fresh`` are the new ones. A
    text between spaces that is no lattice word (see ``Lattices.words``) gets none; ``refused`` tells
    that one was asked for."""

    def __init__(self, unfit: re.Pattern) -> None:
        self.unfit = unfit
        self.fresh: list[str] = []
        self.refused = False

    def __missing__(self, key: str) -> int:
        if self.unfit.search(key):
            self.refused = True
            return -1
        return self.number(key)

    def number(self, key: str) -> int:
        got = self.get(key)
        if got is None:
            self[key] = got = len(self)
            self.fresh.append(key)
        return got


class Lattices:
    """Lattices of distinct words: nodes, and for each node its edges in a row.

    word_draws: places of ``DRAWS`` draws that a word's path may need.
    edge arrays: share (running sum of probabilities within the node, 1 at its last edge), grains (log
    probability in 1 / GRAIN), follow (the next node, -1 at the word's end), piece (id, or SPECIAL + code point of a character
    of several byte pieces).
    """

    SPECIAL = 1 << 20

    def __init__(self, vocabulary: Vocabulary, theta: float = THETA) -> None:
        self.vocabulary, self.theta = vocabulary, theta
        order = np.cumsum(vocabulary.normal) - 1
        ranks = np.arange(int(order[-1]) + 1) if len(order) else np.arange(1)
        total = math.log((1 / (ranks + ZIPF)).sum())
        self.scores = theta * np.where(vocabulary.normal, -np.log(np.maximum(order, 0) + ZIPF) - total, 0.0)
        self.byte_score = theta * (-math.log(len(ranks) + ZIPF) - total)
        self.weights, self.byte_weight = np.exp(self.scores), math.exp(self.byte_score)
        self.stretch = np.exp(theta * 7.0 * np.arange(MAX_PIECE + 1))
        self._trie()
        held = {c for p, n in zip(vocabulary.pieces, vocabulary.normal) if n and len(p) > 1 for c in p}
        alone = "".join(c for c in CONTROLS if c not in held)
        # lattice words: a character that stands alone, or spaces and what follows them
        self.units = re.compile((f"[{alone}]|" if alone else "") + rf"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+")
        #: Texts between single spaces that are more than one lattice word after a space.
        self.unfit = re.compile(rf"^\n?\Z|[{SPACE}{alone.replace(chr(10), '')}]")
        self.lines = "\n" in alone
        # the columns grow in rooms that are kept when the lattices are cleared
        self.room = {name: np.empty(1 << 16, dtype=kind) for name, kind in self.COLUMNS.items()}
        self.clear()

    def _trie(self) -> None:
        pieces = [(p, i) for i, (p, n) in enumerate(zip(self.vocabulary.pieces, self.vocabulary.normal)) if n]
        letters = sorted({c for p, _ in pieces for c in p})
        self.symbol = np.zeros(0x110000, dtype=np.int32)
        self.symbol[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.alphabet = len(letters) + 1
        moves: dict[tuple[int, str], int] = {}
        ends: dict[int, int] = {}
        for piece, number in pieces:
            state = 0
            for c in piece:
                state = moves.setdefault((state, c), len(moves) + 1)
            ends[state] = number
        self.ends = np.full(len(moves) + 1, -1, dtype=np.int32)
        self.ends[list(ends)] = list(ends.values())
        # moves as a hash table with open addressing
        keys = np.array([s * self.alphabet + int(self.symbol[ord(c)]) for s, c in moves], dtype=np.int32)
        values = np.array(list(moves.values()), dtype=np.int32)
        self.bits = max(4, int(len(moves) * 3).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, dtype=np.int32), np.zeros(1 << self.bits, dtype=np.int32)
        slots, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slots[todo]] == -1]
            _, first = np.unique(slots[free], return_index=True)
            placed = free[first]
            self.keys[slots[placed]], self.values[slots[placed]] = keys[placed], values[placed]
            todo = np.setdiff1d(todo, placed)
            slots[todo] = (slots[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint32) * np.uint32(0x9E3779B1)
        return (mixed >> np.uint32(32 - self.bits)).astype(np.int32)

    def _move(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The next state, or 0 where there is none."""
        keys = states * np.int32(self.alphabet) + symbols
        slots = self._slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], 0)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    COLUMNS = {"word_node": np.int32, "word_draws": np.int32, "first": np.int32, "degree": np.int32, "share": np.float64, "grains": np.int64, "follow": np.int32, "piece": np.int32}

    def clear(self) -> None:
        self.known = WordNumbers(self.unfit)
        for name in self.COLUMNS:
            setattr(self, name, self.room[name][:0])

    def _append(self, **columns: np.ndarray) -> None:
        for name, values in columns.items():
            n, room = len(getattr(self, name)), self.room[name]
            if n + len(values) > len(room):
                self.room[name] = np.empty(max(len(room) * 5 // 4, n + len(values)), dtype=room.dtype)
                self.room[name][:n] = room[:n]
            self.room[name][n : n + len(values)] = values
            setattr(self, name, self.room[name][: n + len(values)])

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words of the texts in a row, and how many words each text has.

        In the dictionary a word after a space goes by itself, another one after a line feed, and a
        line feed or a word that holds further spaces after two of them."""
        if len(self.share) > KEPT_EDGES:
            self.clear()
        known, number_of = self.known, self.known.__getitem__
        numbers: list[int] = []
        counts = np.empty(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            first = len(numbers)
            if not self.lines and "\n" in text:
                known.refused = True
            elif text:
                numbers.extend(map(number_of, text.replace("\n", " \n\n \n").split(" ")))
            if known.refused:
                known.refused = False
                del numbers[first:]
                numbers.extend(map(known.number, self._spelled(text)))
            counts[i] = len(numbers) - first
        if known.fresh:
            self._add([w[2:] if w[:2] == "\n\n" and len(w) > 2 else w[1:] if w[0] == "\n" else SPACE + w for w in known.fresh])
            known.fresh = []
        return np.array(numbers, dtype=np.int64), counts

    def _spelled(self, text: str) -> list[str]:
        """Dictionary words of a text of whatever characters."""
        units = self.units.findall(SPACE + text.replace(SPACE, ALIEN).replace(" ", SPACE))
        keys = []
        for u in units:
            after = u.removeprefix(SPACE)
            if SPACE in after or not after or (after[0] == "\n" and u != "\n"):
                keys.append("\n\n" + u)
            else:
                keys.append(after if u != after else "\n" + u)
        return keys

    def _add(self, words: list[str]) -> None:
        """Append the lattices of new words."""
        lengths = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.int32)
        total = len(codes)
        starts = np.cumsum(lengths) - lengths
        # a cell is a character of a word; how many characters it is from the word's end
        left = (np.repeat(starts + lengths, lengths) - np.arange(total)).astype(np.int32)
        symbols = self.symbol[codes]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        cell, state = np.arange(total, dtype=np.int32), np.zeros(total, dtype=np.int32)
        for size in range(1, MAX_PIECE + 1):
            state = self._move(state, symbols[cell + size - 1])
            ends = self.ends[state]
            ended = np.flatnonzero(ends >= 0)
            found.append((cell[ended], ends[ended]))
            # on with those that a longer piece may begin like, if the word goes on
            alive = np.flatnonzero((state > 0) & (left[cell] > size))
            cell, state = cell[alive], state[alive]
        alone = np.full(total, -1, dtype=np.int32)
        alone[found[0][0]] = found[0][1]
        missing = np.flatnonzero(alone < 0)
        lost = np.where(codes[missing] == ord(ALIEN), ord(SPACE), codes[missing])
        alone[missing] = np.where(lost < 0x80, self.vocabulary.first_byte + lost, self.SPECIAL + lost)
        found[0] = (np.arange(total, dtype=np.int32), alone)
        # edges by cell, longer ones first
        degree = sum(np.bincount(cells, minlength=total) for cells, _ in found)
        firsts = np.cumsum(degree) - degree
        n = int(degree.sum())
        source, piece, reach = np.empty(n, dtype=np.int32), np.empty(n, dtype=np.int32), np.empty(n, dtype=np.int32)
        slot = firsts.copy()
        for size in range(MAX_PIECE, 0, -1):
            cells, ids = found[size - 1]
            at = slot[cells]
            slot[cells] += 1
            source[at], piece[at], reach[at] = cells, ids, size
        # every path covers a word's characters once: a factor for each keeps sums in range, but in
        # long words, where they are sums times exp(scale) further than PLAIN_CHARS from the end
        weight = self.weights[np.minimum(piece, len(self.weights) - 1)] * self.stretch[reach]
        weight[firsts[missing] + degree[missing] - 1] = self.byte_weight * self.stretch[1]
        remaining = left[source]
        final = remaining == reach
        target = source + reach
        target[final] = total
        # sums over the paths from each cell to its word's end, the last cells first
        sums, scale = np.ones(total + 1), np.zeros(total + 1)
        distance = remaining.astype(np.uint16 if lengths.max() < 1 << 16 else np.int32)
        order = np.argsort(distance, kind="stable")
        bounds = np.searchsorted(distance[order], np.arange(1, int(lengths.max()) + 2))
        for size, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()), 1):
            part = order[a:b]
            if len(part):
                cells = source[part]
                heads = np.concatenate(([0], np.flatnonzero(cells[1:] != cells[:-1]) + 1))
                terms = weight[part] * sums[target[part]]
                if size <= PLAIN_CHARS:
                    sums[cells[heads]] = np.add.reduceat(terms, heads)
                else:
                    # against the next cell's scale, which is near those of all targets
                    terms *= np.exp(scale[target[part]] - scale[cells + 1])
                    scale[cells[heads]] = scale[cells[heads] + 1] + np.log(np.add.reduceat(terms, heads))
        chance = weight * sums[target] / sums[source]
        far = np.flatnonzero(remaining > PLAIN_CHARS)
        chance[far] *= np.exp(scale[target[far]] - scale[source[far]])
        share = chance.copy()
        nodes, depth = np.arange(total), 1
        while len(nodes := nodes[degree[nodes] > depth]):
            share[firsts[nodes] + depth] += share[firsts[nodes] + depth - 1]
            depth += 1
        share[firsts + degree - 1] = 1.0
        base, edge = len(self.first), len(self.share)
        follow = target + base
        follow[final] = -1
        self._append(
            word_node=base + starts, word_draws=1 + (lengths - 1) // DRAWS, first=edge + firsts, degree=degree, share=share, grains=np.rint(np.log(chance) * GRAIN),
            follow=follow, piece=piece,
        )

    def chance(self, edges: np.ndarray) -> np.ndarray:
        """Probabilities of edges within their nodes; 0 for -1."""
        return np.where(edges >= 0, np.exp(self.grains[edges] / GRAIN), 0.0)

    def walk(self, nodes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Random paths from the nodes to their words' ends: all edges in a row, and how many each
        path has. ``seeds`` has a 64-bit counter for each path."""
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        active, node, step = np.arange(len(nodes)), nodes, np.uint64(0)
        lengths = np.zeros(len(nodes), dtype=np.int64)
        while len(active):
            draw = mix_bits(seeds[active] + step)
            edge = self.first[node]
            open_ = np.flatnonzero(draw > self.share[edge])
            while len(open_):
                edge[open_] += 1
                open_ = open_[draw[open_] > self.share[edge[open_]]]
            steps.append((active, edge))
            lengths[active] += 1
            node = self.follow[edge]
            on = node >= 0
            active, node, step = active[on], node[on], step + np.uint64(1)
        starts = np.cumsum(lengths) - lengths
        out = np.empty(int(lengths.sum()), dtype=np.int32)
        for i, (at, edge) in enumerate(steps):
            out[starts[at] + i] = edge
        return out, lengths


@dataclass
class Sample:
    """One sample of each row (rows without a further segmentation left out): edges in a row and
    their number by row, words begun before each edge, log probability and Gumbel of each row."""

    rows: np.ndarray
    edges: np.ndarray
    counts: np.ndarray
    words: np.ndarray
    log_prob: np.ndarray
    gumbel: np.ndarray


@dataclass
class Branches:
    """Branches left open: row, bound, sample and edge number they leave, log mass up to there,
    edges that were taken there before (-1: none)."""

    row: np.ndarray
    bound: np.ndarray
    sample: np.ndarray
    at: np.ndarray
    mass: np.ndarray
    taken: np.ndarray

    def pick(self, keep: np.ndarray) -> Branches:
        return Branches(*(getattr(self, f)[keep] for f in ("row", "bound", "sample", "at", "mass", "taken")))

    def join(self, other: Branches) -> Branches:
        return Branches(*(np.concatenate((getattr(self, f), getattr(other, f))) for f in ("row", "bound", "sample", "at", "mass", "taken")))


def _truncated(bound: np.ndarray, mass: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Gumbels at ``mass`` truncated at ``bound``."""
    with np.errstate(divide="ignore", over="ignore"):
        return -np.logaddexp(-bound, np.log(-np.log(draw)) - mass)


def sample_texts(lattices: Lattices, texts: list[str], seeds: np.ndarray, k: int) -> tuple[list[Sample], np.ndarray]:
    """Up to k distinct samples of each text by perturbed A*, and kappa of each text."""
    numbers, word_counts = lattices.words(texts)
    word_row = np.repeat(np.arange(len(texts)), word_counts)
    word_start = np.cumsum(word_counts) - word_counts
    place = np.arange(len(numbers)) - word_start[word_row]
    nodes = lattices.word_node[numbers]
    # a word's first place of draws, in its text
    draws = lattices.word_draws[numbers].astype(np.int64)
    drawn = np.cumsum(draws) - draws
    slot = drawn - drawn[np.minimum(word_start, len(numbers) - 1)][word_row] if len(numbers) else place

    def counter(rows: np.ndarray, places: np.ndarray, number: int, purpose: int) -> np.ndarray:
        # so many draws of each place, sample and purpose
        salt = (number * 4 + purpose) * 0xD1342543DE82EF95 % 2**64
        return (seeds[rows] ^ np.uint64(salt)) + places.astype(np.uint64) * np.uint64(DRAWS)

    def finish(number: int, rows: np.ndarray, edges: np.ndarray, counts: np.ndarray, words: np.ndarray, gumbel: np.ndarray,
               since: np.ndarray, taken: np.ndarray) -> tuple[Sample, Branches]:
        """The sample and the branches that leave it at or after edge ``since``; ``taken`` are the
        edges already taken at ``since`` itself."""
        start = np.cumsum(counts) - counts
        grains = lattices.grains[edges]
        total = np.zeros(len(rows))
        some = np.flatnonzero(counts)
        total[some] = np.add.reduceat(grains, start[some]) / GRAIN if len(some) else 0.0
        # branches leave near the text's begin: look as far as any log mass is above -DEPTH
        depth, open_ = HEAD, True
        while open_:
            near = np.minimum(counts, depth)
            span = _spans(start, near)
            row = np.repeat(np.arange(len(rows)), near)
            summed = np.concatenate(([0], np.cumsum(grains[span])))
            first_of = np.cumsum(near) - near
            mass = (summed[:-1] - summed[first_of][row]) / GRAIN
            last = (summed[first_of + near] - summed[first_of]) / GRAIN
            open_ = bool(((counts > near) & (last > -DEPTH)).any())
            depth *= 4
        at = np.arange(len(span)) - first_of[row]
        keep = np.flatnonzero((mass > -DEPTH) & (at >= since[row]))
        head, row, at, mass = span[keep], row[keep], at[keep], mass[keep]
        gone = np.full((len(head), k), -1, dtype=np.int32)
        first = at == since[row]
        gone[first] = taken[row[first]]
        gone[:, number] = edges[head]
        left = 1 - lattices.chance(gone).sum(axis=1)
        # an edge that is alone at its node leaves nothing, whatever rounding says
        left[left < 1e-12] = 0.0
        draw = mix_bits(counter(rows[row], at, number, 1))
        with np.errstate(divide="ignore"):
            bound = _truncated(gumbel[row], mass + np.log(left), draw)
        live = left > 0
        branches = Branches(rows[row], bound, np.full(len(row), number), at, mass, gone).pick(live)
        return Sample(rows, edges, counts, words, total, gumbel), branches

    everyone = np.arange(len(texts))
    edges, lengths = lattices.walk(nodes, counter(word_row, slot, 0, 0))
    counts = np.bincount(word_row, lengths, len(texts)).astype(np.int64)
    gumbel = -np.log(-np.log(mix_bits(counter(everyone, np.zeros(len(texts), dtype=np.int64), 0, 2))))
    none = np.full((len(texts), k), -1, dtype=np.int32)
    sample, branches = finish(0, everyone, edges, counts, np.repeat(place, lengths), gumbel, np.zeros(len(texts), dtype=np.int64), none)
    samples = [sample]
    for number in range(1, k + 1):
        best = np.lexsort((branches.bound, branches.row))
        best = best[np.append(branches.row[best][1:] != branches.row[best][:-1], True)] if len(best) else best
        if number == k:
            break
        chosen = branches.pick(best)
        branches = branches.pick(np.setdiff1d(np.arange(len(branches.row)), best))
        sample, more = _branch_off(lattices, samples, chosen, number, counter, finish, (nodes, word_start, word_counts, slot))
        samples.append(sample)
        branches = branches.join(more)
    kappa = np.full(len(texts), -np.inf)
    kappa[branches.row[best]] = branches.bound[best]
    return samples, kappa


def _branch_off(lattices: Lattices, samples: list[Sample], chosen: Branches, number: int, counter, finish, words) -> tuple[Sample, Branches]:
    """The samples that leave ``samples`` at the chosen branches, one for each of their rows."""
    nodes, word_start, word_counts, slot = words
    rows, n = chosen.row, len(chosen.row)
    # where each chosen row lies in the sample it leaves
    left_edge, word = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    heads: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for s, sample in enumerate(samples):
        mine = np.flatnonzero(chosen.sample == s)
        start = (np.cumsum(sample.counts) - sample.counts)[np.searchsorted(sample.rows, rows[mine])]
        left_edge[mine] = sample.edges[start + chosen.at[mine]]
        word[mine] = sample.words[start + chosen.at[mine]]
        span = _spans(start, chosen.at[mine])
        heads.append((mine, sample.edges[span], sample.words[span]))
    # an edge at the branch's node that was not taken before
    node = np.searchsorted(lattices.first, left_edge.astype(np.int32), "right") - 1
    edge = lattices.first[node].astype(np.int64)
    gone = lattices.chance(chosen.taken).sum(axis=1)
    want = mix_bits(counter(rows, chosen.at, number, 3)) * (1 - gone)
    pick, passed, open_ = edge.copy(), np.zeros(n), np.arange(n)
    ends = edge + lattices.degree[node]
    while len(open_):
        free = ~(chosen.taken[open_] == edge[open_, None]).any(axis=1)
        pick[open_[free]] = edge[open_[free]]
        passed[open_] += np.where(free, lattices.chance(edge[open_]), 0.0)
        edge[open_] += 1
        open_ = open_[((passed[open_] < want[open_]) | ~free) & (edge[open_] < ends[open_])]
    # on to the end of the word, then the words after it
    follow = lattices.follow[pick]
    inner = np.flatnonzero(follow >= 0)
    rest, rest_lengths = lattices.walk(follow[inner], counter(rows[inner], slot[word_start[rows[inner]] + word[inner]], number, 0))
    rest_counts = np.zeros(n, dtype=np.int64)
    rest_counts[inner] = rest_lengths
    later = word_counts[rows] - word - 1
    span = _spans(word_start[rows] + word + 1, later)
    span_row = np.repeat(np.arange(n), later)
    span_place = span - word_start[rows][span_row]
    tail, tail_lengths = lattices.walk(nodes[span], counter(rows[span_row], slot[span], number, 0))
    tail_counts = np.bincount(span_row, tail_lengths, n).astype(np.int64)
    counts = chosen.at + 1 + rest_counts + tail_counts
    start = np.cumsum(counts) - counts
    edges, places = np.empty(int(counts.sum()), dtype=np.int32), np.empty(int(counts.sum()), dtype=np.int64)
    for mine, head_edges, head_words in heads:
        to = _spans(start[mine], chosen.at[mine])
        edges[to], places[to] = head_edges, head_words
    edges[start + chosen.at], places[start + chosen.at] = pick, word
    to = _spans(start + chosen.at + 1, rest_counts)
    edges[to], places[to] = rest, np.repeat(word, rest_counts)
    to = _spans(start + chosen.at + 1 + rest_counts, tail_counts)
    edges[to], places[to] = tail, np.repeat(span_place, tail_lengths)
    return finish(number, rows, edges, counts, places, chosen.bound, chosen.at, chosen.taken)


def piece_ids(lattices: Lattices, sample: Sample) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows of a sample in a row, and how many each row has."""
    ids, counts = lattices.piece[sample.edges], sample.counts
    special = np.flatnonzero(ids >= Lattices.SPECIAL)
    if not len(special):
        return ids, counts
    width = np.ones(len(ids), dtype=np.int64)
    spelled = [chr(c).encode() for c in (ids[special] - Lattices.SPECIAL).tolist()]
    width[special] = [len(b) for b in spelled]
    out = np.repeat(ids, width)
    at = np.cumsum(width) - width
    spell = np.frombuffer(b"".join(spelled), dtype=np.uint8)
    out[_spans(at[special], width[special])] = spell.astype(np.int32) + lattices.vocabulary.first_byte
    row = np.repeat(np.arange(len(counts)), counts)
    return out, np.bincount(row, width, len(counts)).astype(np.int64)


class Decoder:
    """Texts of piece ids: U+2581 becomes a space, byte pieces their bytes, and the one space that
    encoding has put before the text goes."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.bytes = [
            p.replace(SPACE, " ").encode() if normal else b"" for p, normal in zip(vocabulary.pieces, vocabulary.normal)
        ]
        for b in range(256):
            self.bytes[vocabulary.first_byte + b] = bytes([b])
        self.lengths = np.array([len(b) for b in self.bytes])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)

    def __call__(self, ids: list[int]) -> str:
        return b"".join([self.bytes[i] for i in ids])[1:].decode("utf-8", "replace")

    def gives(self, ids: np.ndarray, counts: np.ndarray, texts: list[str]) -> list[bool]:
        """Whether the ids of each row (``counts`` of them) decode to its text."""
        lengths = self.lengths[ids]
        decoded = self.flat[_spans(self.starts[ids], lengths)].tobytes()
        wanted = [b" " + t.encode() if t else b"" for t in texts]
        if decoded == b"".join(wanted):
            row_lengths = np.diff(np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(counts)))])
            if row_lengths.tolist() == list(map(len, wanted)):
                return [True] * len(texts)
        ends = np.cumsum(counts).tolist()
        return [self(ids[a:b].tolist()) == t for a, b, t in zip([0, *ends], ends, texts)]


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_CHARS:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


@lru_cache(maxsize=1)
def _kept(model: str, theta: float, vocabulary: Broadcast) -> tuple[Lattices, Decoder]:
    """A Python worker's lattices and decoder, kept for its next tasks."""
    return Lattices(vocabulary.value, theta), Decoder(vocabulary.value)


def encode_samples(docs: DataFrame, k: int = SAMPLES, theta: float = THETA, model: str = MODEL, seed: int = SEED) -> DataFrame:
    """``docs``: doc_id, text. One row for each sample of each row: doc_id, sample (from 1, in the
    order of their Gumbels), ids, log_prob, inclusion, round_trip (whether the ids decode to the
    text)."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(model))
    kind = dict(docs.dtypes)["doc_id"]
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", F.lit(seed)).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices, decode = _kept(model, theta, vocabulary)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            keys = np.asarray(batch.column("key")).astype(np.uint64)
            for a, b in _chunks(texts):
                samples, kappa = sample_texts(lattices, texts[a:b], keys[a:b], k)
                for number, sample in enumerate(samples):
                    ids, counts = piece_ids(lattices, sample)
                    offsets = np.concatenate(([0], np.cumsum(counts)))
                    right = decode.gives(ids, counts, [texts[a + r] for r in sample.rows.tolist()])
                    with np.errstate(over="ignore"):
                        inclusion = -np.expm1(-np.exp(sample.log_prob - kappa[sample.rows]))
                    columns = {
                        "doc_id": batch.column("doc_id").slice(a, b - a).take(pa.array(sample.rows)),
                        "sample": pa.array(np.full(len(counts), number + 1, dtype=np.int32)),
                        "ids": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                        "log_prob": pa.array(sample.log_prob),
                        "inclusion": pa.array(inclusion),
                        "round_trip": pa.array(right, pa.bool_()),
                    }
                    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return keyed.mapInArrow(
        run, f"doc_id {kind}, sample int, ids array<int>, log_prob double, inclusion double, round_trip boolean"
    )


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """Adds ``text``, decoded from ``ids`` (null ids: null)."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(load(model))

    @F.arrow_udf("string")
    def text_of(ids: pa.Array) -> pa.Array:
        spell = Decoder(vocabulary.value)
        return pa.array([None if x is None else spell(x) for x in ids.to_pylist()], pa.string())

    return encoded.withColumn("text", text_of("ids"))


def op6_encode(docs: DataFrame) -> DataFrame:
    """Two sampled segmentations of every document."""
    return encode_samples(docs).withColumn("n_pieces", F.size("ids"))
