"""SentencePiece sampling without replacement, and decoding.

A text (a leading mark added, spaces made marks) is a lattice of vocabulary pieces; characters that no piece has fall
back to byte pieces. No piece goes from other characters to a mark, so the lattice is a chain of units, each a run of
marks with what follows; equal units are handled once for a batch. A piece's weight comes from its rank in the
vocabulary: log p = -log(rank + 2), byte pieces BYTE each; the segmentations of a text are then distributed as in a
unigram model, with exact normalisation by backward log-sum-exp.

The k samples are the k segmentations of largest Gumbel-perturbed log probability: an A-star search keeps prefixes with
the largest perturbed value of all their completions. Its bound is exact: a popped prefix hands its value to one of its
extensions (so that the next pops complete it), and the others get Gumbel values truncated at it. So the first k complete
pops are k distinct samples without replacement. Many texts are searched in step in numpy, a whole completion at a time.
Siblings that can't be among the first k + 1 any more get no value: MARGIN is more than any Gumbel value that is drawn.

Random numbers are hashes of (seed, row key, place in the search), of 52 bits: a row gets the same samples in any batch.
A draw that lies near a limit between two pieces in single precision is made again in double precision.

The inclusion score is log of the chance that the sample's perturbed value exceeds the threshold, the (k + 1)-th largest
value: log(1 - exp(-exp(log p - threshold))); it is 0 if there are at most k segmentations.

Defined cases: a null text gives no rows; an empty text has one, empty segmentation; texts with fewer than k
segmentations give all of them; texts of any length are searched whole; an empty table gives no rows; a literal U+2581 decodes as a space, so such texts do not round-trip; a null key is a key
like any other; equal rows give equal samples; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, powers, slices, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, SEED = 2, 99
MARK = "▁"
#: Log weight of a byte piece; bytes of text searched in step.
BYTE, STEP_BYTES = -12.0, 1 << 21
#: Above the largest Gumbel value of a 52-bit draw, 53 * log 2: siblings so many nats too low are out of reach for certain.
MARGIN = 36.8
#: Single precision decides a draw that is farther than this from a limit.
NEAR = np.float32(2.0**-21)
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
SLOTS = 1 << 20

_LOADED: dict[int, Vocabulary] = {}


def _mixed(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(np.uint64) + np.uint64(0x51_7CC1_B727_2201))


_SYMBOL = _mixed(np.arange(1 << 16))


def _symbols(points: np.ndarray) -> np.ndarray:
    """A 64-bit number for each code point, from a table for all but the rare ones."""
    out = _SYMBOL[np.minimum(points, 0xFFFF)]
    rare = np.flatnonzero(points > 0xFFFF)
    out[rare] = _mixed(points[rare])
    return out


def _prefix_sums(points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum(_symbols(points) * powers(BASE, len(points)), out=out[1:])
    return out


def _hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, back: np.ndarray) -> np.ndarray:
    return (sums[end] - sums[start]) * back[start]


class Vocabulary:
    """The pieces of a model: look-up by hash, log weights, and bytes for decoding."""

    def __init__(self, proto: bytes) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = model.get_piece_size()
        self.bytes: list[bytes] = []
        self.byte_ids = np.zeros(256, dtype=np.int64)
        plain = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.bytes.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes.append(b"")
            else:
                self.bytes.append(piece.replace(MARK, " ").encode())
                plain.append((i, piece, -np.log(min(-model.get_score(i), n) + 2)))
        self.longest = max(len(p) for _, p, _ in plain)
        self.log = np.zeros(n)
        self.log[[i for i, _, _ in plain]] = [w for _, _, w in plain]
        # every prefix of a piece has an entry, so that a look-up can stop where no piece goes on
        entries = {p[:j]: (-1, 0.0) for _, p, _ in plain for j in range(1, len(p))} | {p: (i, w) for i, p, w in plain}
        self.id = np.array([i for i, _ in entries.values()], dtype=np.int32)
        self.weight = np.array([w for _, w in entries.values()], dtype=np.float64)
        self.hash = np.array([_prefix_sums(np.array([ord(c) for c in p]))[-1] for p in entries], dtype=np.uint64)
        self.slot = np.full(SLOTS, -1, dtype=np.int32)
        for k, h in enumerate(self.hash.tolist()):
            at = h >> 44
            while self.slot[at] >= 0:
                at = (at + 1) % SLOTS
            self.slot[at] = k
        self.size = np.array([len(b) for b in self.bytes])
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.data = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of the piece, or prefix of one, with each hash, or -1."""
        at = (hashes >> np.uint64(44)).astype(np.int64)
        out = self.slot[at]
        rest = np.flatnonzero((out >= 0) & (self.hash[out] != hashes))
        while len(rest):
            at[rest] = (at[rest] + 1) % SLOTS
            out[rest] = self.slot[at[rest]]
            rest = rest[(out[rest] >= 0) & (self.hash[out[rest]] != hashes[rest])]
        return out

    def decode_all(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all pieces one after another."""
        size = self.size[ids]
        ends = np.cumsum(size)
        if not len(ends):
            return np.zeros(0, dtype=np.uint8)
        return self.data[np.arange(ends[-1]) + np.repeat(self.start[ids] - (ends - size), size)]

    def decode(self, ids) -> str:
        """The text of a segmentation. Broken bytes become U+FFFD; the mark that encoding puts in front is taken off."""
        text = self.decode_all(np.asarray(ids, dtype=np.int64)).tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def vocabulary(proto: bytes) -> Vocabulary:
    key = hash(proto)
    if key not in _LOADED:  # once a process
        _LOADED[key] = Vocabulary(proto)
    return _LOADED[key]


class Lattice:
    """Units of several texts, and for each character of the distinct ones the pieces that may begin there.

    In row c, column j: size, characters of the j-th piece from character c (0: there is none); piece, its id; chance, its
    log chance given that a piece begins at c; ladder, running sums of the chances.
    """

    def __init__(self, texts: list[str], vocab: Vocabulary) -> None:
        self.vocab = vocab
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        first = np.concatenate([[0], np.cumsum([len(t) for t in marked])])
        is_mark = points == ord(MARK)
        begins = is_mark & ~np.concatenate([[False], is_mark[:-1]]) if len(points) else is_mark
        begins[first[:-1][first[:-1] < len(points)]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(points))
        self.first = np.searchsorted(start, first)  # the first unit of each text
        back = powers(UNBASE, len(points) + 1)
        self.unit, kinds = pd.factorize(_hash(_prefix_sums(points), start, end, back) ^ (end - start).astype(np.uint64))
        where = np.empty(len(kinds), dtype=np.int64)
        where[self.unit[::-1]] = np.arange(len(start))[::-1]
        self.length = (end - start)[where]
        self.base = np.concatenate([[0], np.cumsum(self.length)])
        n = int(self.base[-1])
        self.points = points[_ranges(start[where], self.length)]
        left = np.repeat(self.base[1:], self.length) - np.arange(n)  # characters up to the end of the unit
        sums, columns = _prefix_sums(self.points), 8
        self.size, self.piece, weight = np.zeros((n, columns), dtype=np.int8), np.zeros((n, columns), dtype=np.int32), np.full((n, columns), -np.inf, dtype=np.float32)
        many = np.zeros(n, dtype=np.int64)

        def put(at: np.ndarray, size: int, piece: np.ndarray, log: np.ndarray) -> None:
            nonlocal weight
            column = many[at]
            if len(at) and column.max() >= weight.shape[1]:
                wider = lambda x, fill: np.concatenate([x, np.full_like(x, fill)], axis=1)
                self.size, self.piece, weight = wider(self.size, 0), wider(self.piece, 0), wider(weight, -np.inf)
            self.size[at, column], self.piece[at, column], weight[at, column] = size, piece, log
            many[at] = column + 1

        at = np.arange(n)
        for k in range(1, vocab.longest + 1):
            found = vocab.find(_hash(sums, at, at + k, back))
            known = found >= 0
            whole = np.flatnonzero(known)
            whole = whole[vocab.id[found[whole]] >= 0]
            put(at[whole], k, vocab.id[found[whole]], vocab.weight[found[whole]])
            if k == 1:  # characters without a piece of their own fall back to their bytes
                bare = np.flatnonzero(many == 0)
                p = self.points[bare].astype(np.int64)
                put(bare, 1, -2 - p, BYTE * (1 + (p >= 0x80).astype(int) + (p >= 0x800) + (p >= 0x10000)))
            at = at[known]
            at = at[left[at] > k]
            if not len(at):
                break
        # backward log-sum-exp, by distance from the end of the unit; every unit has a node after its last character
        self.node = node = np.arange(n) + np.repeat(np.arange(len(kinds)), self.length)
        self.beta = beta = np.zeros(n + len(kinds))
        # runs for each distance and number of pieces; one piece has chance 1, and more are summed a column at a time
        key = 4 * left + np.minimum(many, 4) - 1
        order = np.argsort(key.astype(np.uint16) if key.max(initial=0) < 65_536 else key, kind="stable")
        ordered = key[order]
        cuts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])) if n else np.zeros(1, dtype=np.int64)
        logs, sizes, here = weight.take(order, axis=0), self.size.take(order, axis=0), node[order]
        ladder = np.full(weight.shape, 2.0, dtype=np.float32)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            width = int(ordered[a] & 3) + 1
            if width == 1:
                beta[here[a:b]] = logs[a:b, 0] + beta[here[a:b] + sizes[a:b, 0]]
                logs[a:b, 0] = 0
                continue
            if width == 4:
                width = weight.shape[1]
            x = beta[np.add(here[a:b], sizes[a:b, :width].T, order="C")]
            x += logs[a:b, :width].T
            top = x.max(axis=0)
            part = np.cumsum(np.exp(x - top), axis=0)
            total = top + np.log(part[-1])
            beta[here[a:b]] = total
            x -= total
            part /= part[-1].copy()
            for j in range(width):
                logs[a:b, j], ladder[a:b, j] = x[j], part[j]
        weight[order] = logs
        self.ladder = np.empty_like(ladder)
        self.ladder[order] = ladder
        self.chance = weight
        self.ladder[np.arange(n), many - 1] = 2.0  # above any random number
        self.short = np.ascontiguousarray(self.ladder[:, :4])

    def exact(self, rows: np.ndarray) -> np.ndarray:
        """The ladder of some characters in double precision."""
        size, piece = self.size[rows].astype(np.int64), self.piece[rows].astype(np.int64)
        points = np.maximum(-2 - piece, 0)
        spelled = BYTE * (1 + (points >= 0x80).astype(int) + (points >= 0x800) + (points >= 0x10000))
        x = np.where(piece >= 0, self.vocab.log[np.maximum(piece, 0)], spelled) + self.beta[self.node[rows][:, None] + size]
        x[size == 0] = -np.inf
        part = np.cumsum(np.exp(x - x.max(axis=1)[:, None]), axis=1)
        part /= part[:, -1:]
        part[part >= part[:, -1:]] = 2.0  # above any random number
        return part

    def after(self, unit: np.ndarray, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a piece of so many characters leads to."""
        place = place + size
        over = place == self.length[self.unit[unit]]
        return unit + over, np.where(over, 0, place)


def _uniform(key: np.ndarray) -> np.ndarray:
    return ((key >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def walk(lattice: Lattice, keys: np.ndarray, unit: np.ndarray, place: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Draw the rest of each path from (unit, place) on.

    Returns the nodes (their characters), columns and units of all paths in order, and where each path begins.
    """
    left = last - unit
    walker = np.repeat(np.arange(len(unit)), left)
    own = np.arange(len(walker)) - np.repeat(np.cumsum(left) - left, left)
    at_unit = unit[walker] + own
    base = lattice.base[lattice.unit[at_unit]]
    end = base + lattice.length[lattice.unit[at_unit]]
    at = base + np.where(own == 0, place[walker], 0)
    # units are counted from the end of the text, where all paths of a text agree
    key = mix(keys[walker] + (left[walker] - own).astype(np.uint64) * np.uint64(BASE))
    moves, counts, turn = [], np.zeros(len(walker), dtype=np.int64), 0
    table_short, ladder, sizes, width = lattice.short, lattice.ladder, lattice.size.ravel(), lattice.size.shape[1]
    alive = np.arange(len(walker))
    while len(alive):
        u = (key >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)  # the leading bits of the draw
        short = table_short.take(at, axis=0)
        # how many limits lie below, were the draw a little higher or lower: a draw near none has one answer
        above, below = u + NEAR, u - NEAR
        most, least = np.zeros(len(at), dtype=np.uint8), np.zeros(len(at), dtype=np.uint8)
        for limit in short.T:
            most += limit <= above
            least += limit <= below
        column, close = most.astype(np.int64), most != least
        beyond = np.flatnonzero(least == short.shape[1])  # few characters begin many pieces
        if len(beyond):
            long = ladder[at[beyond]]
            column[beyond] = (long > above[beyond, None]).argmax(axis=1)
            close[beyond] = column[beyond] != (long > below[beyond, None]).argmax(axis=1)
        close = np.flatnonzero(close)
        if len(close):
            column[close] = (lattice.exact(at[close]) > _uniform(key[close])[:, None]).argmax(axis=1)
        moves.append((alive, at, column))
        at = at + sizes.take(at * width + column)
        on = at < end[alive]
        counts[alive] = turn + 1
        turn += 1
        alive, at = alive[on], at[on]
        key = mix(key[on] + np.uint64(BASE))
    offset = np.concatenate([[0], np.cumsum(counts)])
    chars, columns = np.empty(offset[-1], dtype=np.int64), np.empty(offset[-1], dtype=np.int64)
    for turn, (alive, at, column) in enumerate(moves):
        to = offset[alive] + turn
        chars[to], columns[to] = at, column
    return chars, columns, np.repeat(at_unit, counts), offset[np.concatenate([[0], np.cumsum(left)])]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... size[0] of them, then those of the next range."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def search(lattice: Lattice, keys: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """The k samples of each text: text, rank, value, log p, the text's threshold, and the nodes (characters) and
    columns of each from begin[i] to begin[i + 1].

    Each round pops the prefix of largest value of every text and draws its completion, which keeps the value. The
    siblings along it get their values, independent Gumbels truncated at the popped one, and join the text's queue, of
    which the first k + 1 - popped entries are all that can be wanted.
    """
    n, last = len(keys), lattice.first[1:]
    text = np.arange(n)
    popped = {x: np.zeros(n, dtype=np.int64) for x in ("path", "node", "char", "column", "place")} | {"unit": lattice.first[:-1].copy(), "logp": np.zeros(n)}
    popped["value"] = -np.log(-np.log(_uniform(mix(keys ^ np.uint64(BASE)))))
    nodes, columns, begin = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)
    queue, done = None, []
    for rank in range(k):
        own = mix(keys[text] + np.uint64(rank + 1))
        chars, picks, units, first = walk(lattice, own, popped["unit"], popped["place"], last[text])
        count = np.diff(first)
        chance = lattice.chance.take(chars * lattice.chance.shape[1] + picks).astype(np.float64)
        run = np.concatenate([[0.0], np.cumsum(chance)])
        before = run[:-1] + np.repeat(popped["logp"] - run[first[:-1]], count)
        done.append((text, np.full(len(text), rank), popped["value"], popped["logp"] + run[first[1:]] - run[first[:-1]]))
        # whole paths: what came before the popped piece, that piece, the rest
        head = popped["node"] + (rank > 0)
        ends = np.cumsum(head + count)
        start = ends - head - count
        whole_nodes, whole_columns = chars, picks
        if rank:
            whole_nodes, whole_columns = np.empty(ends[-1] if len(ends) else 0, dtype=np.int64), np.empty(ends[-1] if len(ends) else 0, dtype=np.int64)
            to, of = _ranges(start, popped["node"]), _ranges(begin[popped["path"]], popped["node"])
            whole_nodes[to], whole_columns[to] = nodes[of], columns[of]
            whole_nodes[start + popped["node"]], whole_columns[start + popped["node"]] = popped["char"], popped["column"]
            to = _ranges(start + head, count)
            whole_nodes[to], whole_columns[to] = chars, picks
        queue = _queued(lattice, own, text, popped["value"], chars, picks, units, before, first, head, len(begin) - 1, queue, k - rank)
        begin = np.concatenate([begin, begin[-1] + ends])
        nodes, columns = np.concatenate([nodes, whole_nodes]), np.concatenate([columns, whole_columns])
        if rank + 1 < k:
            lead = np.concatenate([[True], queue["text"][1:] != queue["text"][:-1]])[: len(queue["text"])]
            text = queue["text"][lead]
            popped = {x: v[lead] for x, v in queue.items() if x != "text"}
            popped["unit"], popped["place"] = lattice.after(popped["unit"], popped["char"] - lattice.base[lattice.unit[popped["unit"]]], lattice.size[popped["char"], popped["column"]])
            queue = {x: v[~lead] for x, v in queue.items()}
    threshold = np.full(n, -np.inf)
    np.maximum.at(threshold, queue["text"], queue["value"])
    text, rank, value, logp = (np.concatenate(x) for x in zip(*done))
    return {"text": text, "rank": rank, "value": value, "logp": logp, "threshold": threshold[text], "node": nodes, "column": columns, "begin": begin}


def _queued(lattice, keys, text, value, chars, picks, units, before, first, head, paths, queue, most) -> dict[str, np.ndarray]:
    """The queue with the siblings along new paths, by text and falling value, cut to the first `most` of each text."""
    if queue is None:
        queue = {x: np.zeros(0, dtype=np.int64) for x in ("text", "path", "node", "char", "column", "unit")} | {x: np.zeros(0) for x in ("value", "logp")}
    count = np.diff(first)
    looked = np.zeros(len(text), dtype=np.int64)  # nodes of each path that are done with
    step = np.minimum(count, 8)

    def last() -> np.ndarray:
        """The last value that can be wanted of each text; of texts with fewer entries all nodes are looked at."""
        bound = np.full(int(max(text.max(initial=0), queue["text"].max(initial=0))) + 1, -np.inf)
        place = np.arange(len(queue["text"])) - np.searchsorted(queue["text"], queue["text"])
        bound[queue["text"][place == most - 1]] = queue["value"][place == most - 1]
        return bound

    queue = _cut(queue, most)
    bound = last()
    while step.any():
        # log p falls along a path: a few more nodes of each that isn't known to be too low
        node = _ranges(first[:-1] + looked, step)
        owner = np.repeat(np.arange(len(text)), step)
        real = lattice.size.take(chars[node], axis=0) > 0
        real[np.arange(len(node)), picks[node]] = False
        r, column = np.nonzero(real)
        node, owner = node[r], owner[r]
        logp = before[node] + lattice.chance[chars[node], column]
        local = node - first[owner]
        key = mix(keys[owner] ^ mix(local.astype(np.uint64) * np.uint64(64) + column.astype(np.uint64) + np.uint64(1)))
        # a Gumbel value above d needs a draw within exp(-d) of 1; most siblings are known to miss by that
        wanted = np.flatnonzero(1 - _uniform(key) <= 1.01 * np.exp(np.minimum(logp - bound[text[owner]], 1)))
        node, owner, column, logp, local, key = (x[wanted] for x in (node, owner, column, logp, local, key))
        raw = logp - np.log(-np.log(_uniform(key)))
        g = value[owner]
        cut = np.minimum(g, raw) - np.log1p(np.exp(-np.abs(g - raw)))
        new = {"text": text[owner], "path": paths + owner, "node": head[owner] + local, "char": chars[node], "column": column, "unit": units[node], "value": cut, "logp": logp}
        if len(wanted):
            queue = _cut({x: np.concatenate([queue[x], new[x]]) for x in queue}, most)
        looked += step
        bound = last()
        more = looked < count
        more[more] = before[first[:-1][more] + looked[more]] >= bound[text[more]] - MARGIN
        step = np.where(more, np.minimum(count - looked, looked), 0)
    return queue


def _cut(queue: dict[str, np.ndarray], most: int) -> dict[str, np.ndarray]:
    """By text and falling value, the first `most` of each text."""
    order = np.lexsort((-queue["value"], queue["text"]))
    ordered = queue["text"][order]
    order = order[np.arange(len(order)) - np.searchsorted(ordered, ordered) < most]
    return {x: v[order] for x, v in queue.items()}


def spelled(lattice: Lattice, node: np.ndarray, column: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids for nodes and columns; characters without a piece become their bytes."""
    pieces = lattice.piece.take(node * lattice.piece.shape[1] + column).astype(np.int64)
    bare = np.flatnonzero(pieces < 0)
    if not len(bare):
        return pieces, begin
    raw = [chr(-2 - x).encode("utf-8", "replace") for x in pieces[bare].tolist()]
    times = np.ones(len(pieces), dtype=np.int64)
    times[bare] = [len(b) for b in raw]
    ends = np.concatenate([[0], np.cumsum(times)])
    wide = np.repeat(pieces, times)
    wide[wide < 0] = lattice.vocab.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    return wide, ends[begin]


def sample_texts(texts: list[str], keys: np.ndarray, vocab: Vocabulary, k: int) -> dict[str, np.ndarray]:
    """All samples of several texts, first ones first: text, rank, value, logp, score, and pieces from begin[i] to begin[i + 1]."""
    lattice = Lattice(texts, vocab)
    found = search(lattice, keys, k)
    pieces, begin = spelled(lattice, found["node"], found["column"], found["begin"])
    logp = found["logp"]
    with np.errstate(divide="ignore", over="ignore"):
        gap = logp - found["threshold"]  # log of the rate at which the sample's value would exceed the threshold
        score = np.where(gap < -30, gap, np.log(-np.expm1(-np.exp(np.minimum(gap, 700)))))
    return {"text": found["text"], "rank": found["rank"], "value": found["value"], "logp": logp, "score": score, "pieces": pieces, "begin": begin}


def row_keys(ids: list, seed: int = SEED) -> np.ndarray:
    """A key for each row id."""
    null = np.array([i is None for i in ids], dtype=bool)
    x = np.array([i or 0 for i in ids], dtype=np.int64).view(np.uint64)
    return mix(mix(x + np.uint64(seed)) ^ np.where(null, np.uint64(0xABCDEF), np.uint64(0)))


def _encoded(batches: Iterator[pa.RecordBatch], proto: bytes, k: int, seed: int, step: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """What `encode` returns, a step at a time, with the text of each sample."""
    vocab = vocabulary(proto)
    for batch in batches:
        for part in slices(batch, "text", step):
            part = part.filter(part.column("text").is_valid())
            texts, ids = part.column("text").to_pylist(), part.column("doc_id")
            if texts:
                got = sample_texts(texts, row_keys(ids.to_pylist(), seed), vocab, k)
                pieces = pa.ListArray.from_arrays(pa.array(got["begin"].astype(np.int32)), pa.array(got["pieces"].astype(np.int32)))
                out = pa.RecordBatch.from_arrays([*_common(ids, got), pieces], ["doc_id", "sample", "n_pieces", "log_p", "perturbed", "inclusion", "pieces"])
                yield out, [texts[i] for i in got["text"].tolist()]


def _common(ids: pa.Array, got: dict[str, np.ndarray]) -> list[pa.Array]:
    count = np.diff(got["begin"])
    return [ids.take(pa.array(got["text"])), pa.array((got["rank"] + 1).astype(np.int32)), pa.array(count.astype(np.int64)), pa.array(got["logp"]), pa.array(got["value"]), pa.array(got["score"])]


_COMMON = "doc_id long, sample int, n_pieces long, log_p double, perturbed double, inclusion double"


def _docs(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(df: DataFrame, proto: bytes, k: int = SAMPLES, seed: int = SEED, step: int = STEP_BYTES) -> DataFrame:
    """Up to k distinct segmentations of each row of (doc_id, text), as piece ids. step: bytes of text searched at once, for less memory or less time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out, _ in _encoded(batches, proto, k, seed, step):
            yield out

    return _docs(df).mapInArrow(run, f"{_COMMON}, pieces array<int>")


def decode(df: DataFrame, proto: bytes) -> DataFrame:
    """df with `decoded`, the text of its `pieces` (null where they are null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(proto)
        for batch in batches:
            texts = [None if p is None else vocab.decode([x for x in p if x is not None]) for p in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    df = df.drop("decoded")
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())]))


def digest(df: DataFrame, proto: bytes, k: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """As `encode`, with a hash of the piece ids in their order, and whether they decode to the text, in their stead.

    Both are taken from what `encode` returns, each sample decoded to its text as by `decode`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(proto)
        for out, texts in _encoded(batches, proto, k, seed):
            column = out.column("pieces")
            begin, pieces = column.offsets.to_numpy(), column.values.to_numpy()
            place = np.arange(len(pieces)) - np.repeat(begin[:-1], np.diff(begin))
            total = np.zeros(len(pieces) + 1, dtype=np.uint64)
            np.cumsum(mix((pieces.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE) + place.astype(np.uint64)), out=total[1:])
            hashes = (total[begin[1:]] - total[begin[:-1]]).view(np.int64)
            same = [vocab.decode(pieces[a:b]) == t for a, b, t in zip(begin[:-1].tolist(), begin[1:].tolist(), texts)]
            yield pa.RecordBatch.from_arrays([*out.columns[:-1], pa.array(hashes), pa.array(same, pa.bool_())], [*out.schema.names[:-1], "pieces_hash", "round_trip"])

    return _docs(df).mapInArrow(run, f"{_COMMON}, pieces_hash long, round_trip boolean")


def load(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def op2_gumbel_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), load())
