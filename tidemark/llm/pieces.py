"""SentencePiece segmentations sampled without replacement, and decoding.

A text is cut before each space (which becomes the mark that pieces start with) and around each line feed; no piece
crosses such a cut, so the lattice of a text is a chain of word lattices. Backward sums turn each lattice into a tree of
choices with known masses. Gumbel top-k then searches that tree from the top, best perturbed value first: a node's value
is the largest of its leaves, so its best child inherits it and the others get Gumbel values truncated below it. The
first k leaves reached are k distinct segmentations, drawn without replacement in order of their perturbed scores.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from tidemark.llm._shared import draw, mix64, row_key

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
#: Characters of text whose words are walked together.
BATCH_CHARS = 1 << 18
#: Different words whose lattices a task keeps from batch to batch.
MAX_WORDS = 1 << 16

_MARK, _SEP, _LITERAL = "▁", "\ud800", "\ud801"
#: Weights carry this factor for each character, which all segmentations of a word share; it keeps sums near one.
_PER_CHAR = 30.0
_WIDE = 1 << 21  # marks an edge that stands for the bytes of one character


class Vocabulary:
    """Pieces of a model as a trie, with a weight for each: Zipf's law over the order in which the model learnt them."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        self.out = [b""] * size
        self.byte_id = [0] * 256
        usable = {}
        for i in range(size):
            piece, score = sp.id_to_piece(i), sp.get_score(i)
            if sp.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_id[value], self.out[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.out[i] = piece.replace(_MARK, " ").encode()
                # Pieces without a place in that order (the lone mark, runs of marks): only single ones are needed.
                if score > -1e8 or len(piece) == 1:
                    usable[piece] = (i, min(1.0 - score, float(size)))
        self.spelt = pa.array(self.out, pa.large_binary())
        total = sum(1.0 / rank for _, rank in usable.values())
        weight = {piece: (i, _PER_CHAR ** len(piece) / (rank * total)) for piece, (i, rank) in usable.items()}
        self.byte_weight = 0.1 * min((1.0 / (rank * total) for _, rank in usable.values()), default=0.1) * _PER_CHAR
        # What a single character stands for: its piece, else its bytes.
        self.single = np.arange(0x110000, dtype=np.int64) | _WIDE
        self.single[ord(_LITERAL)] = _WIDE | ord(_MARK)
        self.single[:128] = self.byte_id[:128]
        self.single_weight = np.full(0x110000, self.byte_weight)
        for piece, (i, w) in weight.items():
            if len(piece) == 1:
                self.single[ord(piece)], self.single_weight[ord(piece)] = i, w
        # Longer pieces: inner nodes of their trie come first and have a row of children, by character class.
        long = {piece: x for piece, x in weight.items() if len(piece) > 1}
        inner = sorted({piece[:n] for piece in long for n in range(len(piece))}, key=len)
        nodes = {prefix: n for n, prefix in enumerate(inner)} or {"": 0}
        self.char_class = np.zeros(0x110000, np.int32)
        for n, c in enumerate(sorted({c for piece in long for c in piece})):
            self.char_class[ord(c)] = n + 1
        for piece in long:
            nodes.setdefault(piece, len(nodes))
        self.inner = max(1, len(inner))
        self.child = np.zeros((self.inner, int(self.char_class.max()) + 1), np.int32)
        self.piece, self.weight = np.full(len(nodes), -1, np.int64), np.zeros(len(nodes))
        for prefix, n in nodes.items():
            if prefix:
                self.child[nodes[prefix[:-1]], self.char_class[ord(prefix[-1])]] = n
            if prefix in long:
                self.piece[n], self.weight[n] = long[prefix]


def words_of(text: str) -> list[str]:
    """Words whose concatenation, marks for spaces, is the text behind one mark; none for an empty text."""
    if not text:
        return []
    text = text.replace(_MARK, _LITERAL).replace(" ", _SEP + _MARK).replace("\n", f"{_SEP}\n{_SEP}")
    return [w for w in (_MARK + text).split(_SEP) if w]


class Lattices:
    """Word lattices as flat arrays.

    ``first``: a node's first edge; for each edge ``run``: the share of its node's mass up to it, ``to``: the next node
    (-1 behind the word), ``code``: what it stands for, ``logs``: log of its share, ``node``: where it starts.
    """

    _KINDS = {"run": np.float32, "logs": np.float32, "to": np.int32, "code": np.int32, "node": np.int32}

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.word: dict[str, int] = {}
        self.nodes = self.edges = 0
        self.first = np.zeros(1 << 16, np.int64)
        for name, kind in self._KINDS.items():
            setattr(self, name, np.zeros(1 << 17, kind))

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        """Write values into an array that doubles when it is full."""
        old = getattr(self, name)
        if at + len(values) > len(old):
            grown = np.zeros(max(2 * len(old), at + len(values)), old.dtype)
            grown[:at] = old[:at]
            setattr(self, name, grown)
        getattr(self, name)[at : at + len(values)] = values

    def trimmed(self, words: list[str], max_words: int = MAX_WORDS) -> None:
        """Forget ``words``, which the last call of `starts` added, if there are more than ``max_words``."""
        if len(self.word) > max_words:
            for w in words:
                del self.word[w]
            self.nodes -= sum(map(len, words))
            self.edges = int(self.first[self.nodes])

    def _add(self, words: list[str]) -> None:
        """Lattices of new words, all at once. Nodes are numbered by the characters left, so sums run over slices."""
        v = self.vocabulary
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        at = np.arange(len(chars))
        left = np.repeat(ends, lengths) - at
        # Short keys are sorted by their digits.
        order = np.argsort(left.astype(np.uint16) if lengths.max() < 1 << 16 else left, kind="stable")
        node = np.empty(len(chars), np.int64)
        node[order] = at
        classes, state, step = v.char_class[chars], np.zeros(len(chars), np.int32), 0
        parts, edges = [], np.ones(len(chars), np.int64)
        while len(at):
            state = v.child[state, classes[at + step]]
            step += 1
            hit = np.flatnonzero(v.weight[state])
            if len(hit):
                parts.append((at[hit], step, state[hit]))
                edges[parts[-1][0]] += 1
            go = np.flatnonzero((state > 0) & (state < v.inner) & (left[at] > step))
            at, state = at[go], state[go]
        # Edges go to their places by node, longest first: they tend to be the likeliest.
        edges = edges[order]
        tail = np.cumsum(edges)
        head = tail - edges
        slot = head[node]
        to, code, weight = (np.empty(int(tail[-1]), kind) for kind in (np.int64, np.int64, np.float64))
        for at, step, state in reversed(parts):
            place = slot[at]
            slot[at] += 1
            to[place] = np.where(left[at] > step, node[np.minimum(at + step, len(chars) - 1)], -1)
            code[place], weight[place] = v.piece[state], v.weight[state]
        to[slot] = np.where(left > 1, np.append(node[1:], -1), -1)
        code[slot], weight[slot] = v.single[chars], v.single_weight[chars]
        log_mass, share = np.zeros(len(chars) + 1), np.empty(len(to))  # the last: what lies behind a word's end
        levels = np.r_[0, np.cumsum(np.bincount(left))[1:]].tolist()
        for lo, hi in zip(levels, levels[1:], strict=False):
            if lo == hi:
                continue
            e_lo, e_hi = head[lo], tail[hi - 1]
            first, times = head[lo:hi] - e_lo, edges[lo:hi]
            logs = log_mass[to[e_lo:e_hi]]
            top = np.maximum.reduceat(logs, first)
            logs -= np.repeat(top, times)
            mass = np.exp(logs, out=logs)
            mass *= weight[e_lo:e_hi]
            total = np.add.reduceat(mass, first)
            np.divide(mass, np.repeat(total, times), out=share[e_lo:e_hi])
            log_mass[lo:hi] = top + np.log(total)
        run = np.cumsum(share)
        run -= np.repeat(np.append(0.0, run)[head], edges)
        run[tail - 1] = 2.0
        base = self.nodes
        self.word.update(zip(words, (node[ends - lengths] + base).tolist(), strict=True))
        self._put("first", base, np.append(head, len(to)) + self.edges)
        to[to >= 0] += base
        values = {"run": run, "logs": np.log(share, out=share), "to": to, "code": code}
        for name, x in (values | {"node": np.repeat(np.arange(base, base + len(chars)), edges)}).items():
            self._put(name, self.edges, x)
        self.nodes, self.edges = base + len(chars), self.edges + len(to)

    def starts(self, words: list[str]) -> tuple[np.ndarray, list[str]]:
        """The node where each word starts, and the words that were new."""
        place = dict.fromkeys(words)  # small beside the words known, so that most words are looked up nearby
        new = [w for w in place if w not in self.word]
        if new:
            self._add(new)
        place = dict(zip(place, map(self.word.__getitem__, place), strict=True))
        return np.fromiter(map(place.__getitem__, words), np.int64, len(words)), new

    def walk(self, node: np.ndarray, mixed_seed: np.ndarray, counter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sample an edge from each node to the end of its word: all edges, word after word, and each word's count."""
        which, found, steps = np.arange(len(node)), [], np.zeros(len(node), np.int64)
        while len(which):
            u = draw(mixed_seed, counter).astype(np.float32)
            edge = self.first[node]
            late = np.flatnonzero(self.run[edge] <= u)
            while len(late):
                edge[late] += 1
                late = late[self.run[edge[late]] <= u[late]]
            found.append((which, edge))
            steps[which] += 1
            node = self.to[edge]
            go = np.flatnonzero(node >= 0)
            which, node, mixed_seed, counter = which[go], node[go], mixed_seed[go], counter[go] + np.uint64(1)
        begin = np.cumsum(steps) - steps
        out = np.zeros(int(steps.sum()), np.int32)
        for n, (which, edge) in enumerate(found):
            out[begin[which] + n] = edge
        return out, steps


def _below(mass: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values with the given log masses, truncated at ``top``."""
    return mass - np.log(np.exp(np.minimum(mass - top, 700.0)) - np.log(u))


#: No Gumbel value that `draw` can give lies further above its location.
_HIGHEST = 38.0
#: Edges of a path that are looked at together.
_SCAN = 512


def _stream(n: int) -> int:
    """Counter of the first draw of a text's stream ``n``."""
    return (1 << 62) + (n << 40)


class _Search:
    """Best-first search of one text's tree of choices."""

    def __init__(self, lattices: Lattices, seed: int, k: int, words: np.ndarray):
        self.lat, self.k, self.words = lattices, k, words
        self.seed = mix64(np.array([seed], np.uint64))
        self.heap: list[tuple] = []
        self.paths: list[tuple[np.ndarray, np.ndarray, float, float]] = []  # edges, word of each edge, log mass, value
        self.ties = 0
        self.logs = self.mass = np.zeros(0)  # of the last path's edges, and of its prefixes

    def found(self, edges: np.ndarray, word: np.ndarray, value: float) -> None:
        """A new leaf."""
        self.logs = self.lat.logs[edges]
        self.mass = np.cumsum(self.logs, dtype=np.float64)
        self.paths.append((edges, word, float(self.mass[-1]) if len(edges) else 0.0, value))

    def branch(self) -> tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray, float, tuple[int, ...]] | None:
        """Take the best open node: the edges up to it with one new edge, the nodes still to walk, and their words."""
        if not self.heap:
            return None
        value, _, parent, at, gone = heapq.heappop(self.heap)
        edges, word = self.paths[parent][:2]
        node = self.lat.node[edges[at]]
        lo, hi = self.lat.first[node : node + 2]
        weights = np.exp(self.lat.logs[lo:hi])
        weights[[g - lo for g in gone]] = 0.0
        run = np.cumsum(weights)
        u = float(draw(self.seed, np.array([_stream((1 << 20) + self.ties)], np.uint64))[0])
        self.ties += 1
        new = lo + min(int(np.searchsorted(run, u * run[-1], side="right")), hi - lo - 1)
        w = int(word[at])
        nodes, of = self.words[w + 1 :], np.arange(w + 1, len(self.words))
        if self.lat.to[new] >= 0:
            nodes, of = np.append(self.lat.to[new], nodes), np.append(w, of)
        head = edges[: at + 1].copy()
        head[at] = new
        return head, word[: at + 1], at, nodes, of, -value, gone


def _opened(found: list[tuple[_Search, int, float, tuple[int, ...]]]) -> None:
    """Open the nodes that the last path of each search leaves: the path branched off at edge ``from_``, whose node has
    ``used`` of its mass gone to ``barred``.

    Every later edge leaves a node open: the rest of its mass. Only the k best of them can matter, and prefix masses
    fall along the path, so its scan ends where no Gumbel value could reach the k-th best. The searches scan together.
    """
    best: list[list[tuple[float, int]]] = [[] for _ in found]
    mass, logs = [s.mass for s, *_ in found], [s.logs for s, *_ in found]
    todo = [(i, from_) for i, (_, from_, _, _) in enumerate(found) if from_ < len(mass[i])]
    while todo:
        lengths = np.array([min(_SCAN, len(mass[i]) - done) for i, done in todo])
        begin = np.cumsum(lengths) - lengths
        of = np.repeat(np.arange(len(todo)), lengths)
        at = np.arange(len(of)) + (np.array([done for _, done in todo]) - begin)[of]
        here = np.concatenate([logs[i][done : done + _SCAN] for i, done in todo])
        rest = -np.expm1(here)
        for (i, done), lo in zip(todo, begin.tolist(), strict=True):
            if done == found[i][1]:
                rest[lo] -= found[i][2]
        keep = np.flatnonzero(rest > 1e-12)
        of, at = of[keep], at[keep]
        before = np.concatenate([mass[i][done : done + _SCAN] for i, done in todo])[keep] - here[keep]
        top = np.array([found[i][0].paths[-1][3] for i, _ in todo])
        seed = np.array([found[i][0].seed[0] for i, _ in todo])
        stream = np.array([_stream(len(found[i][0].paths) - 1) for i, _ in todo], np.uint64)
        values = _below(before + np.log(rest[keep]), top[of], draw(seed[of], stream[of] + at.astype(np.uint64)))
        ends = np.searchsorted(of, np.arange(len(todo) + 1)).tolist()
        after = []
        for (i, done), lo, hi in zip(todo, ends, ends[1:], strict=False):
            s, some = found[i][0], values[lo:hi]
            first = np.argpartition(-some, s.k)[: s.k] if hi - lo > s.k else np.arange(hi - lo)
            best[i] += zip(some[first].tolist(), at[lo:hi][first].tolist(), strict=True)
            best[i] = sorted(best[i], reverse=True)[: s.k]
            done += _SCAN
            if done < len(mass[i]) and not (len(best[i]) == s.k and mass[i][done - 1] + _HIGHEST < best[i][-1][0]):
                after.append((i, done))
        todo = after
    for (s, from_, _, barred), nodes in zip(found, best, strict=True):
        edges = s.paths[-1][0]
        for value, at in nodes:
            gone = (barred if at == from_ else ()) + (int(edges[at]),)
            heapq.heappush(s.heap, (-value, s.ties, len(s.paths) - 1, at, gone))
            s.ties += 1


def sampled(lat: Lattices, texts: list[str], seeds: list[int], k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to ``k`` distinct segmentations: (piece ids, log mass, perturbed value, inclusion score)."""
    searches = []
    words = [words_of(t) for t in texts]
    starts, new = lat.starts(list(chain.from_iterable(words)))
    ends = np.cumsum([len(w) for w in words])
    for w, end, seed in zip(words, ends, seeds, strict=True):
        searches.append(_Search(lat, seed, k, starts[end - len(w) : end]))
    todo = []
    for s in searches:
        g = -math.log(-math.log(float(draw(s.seed, np.array([1 << 61], np.uint64))[0])))
        none = np.zeros(0, np.int64)
        todo.append((s, none, none, 0, s.words, np.arange(len(s.words)), g, ()))
    for sample in range(k):
        nodes = np.concatenate([t[4] for t in todo]) if todo else np.zeros(0, np.int64)
        lengths = [len(t[4]) for t in todo]
        seed = np.repeat(np.array([t[0].seed[0] for t in todo], np.uint64), lengths)
        of = np.concatenate([t[5] for t in todo]) if todo else np.zeros(0, np.int64)
        counter = (of.astype(np.uint64) << np.uint64(24)) + np.uint64(sample << 48)
        edges, steps = lat.walk(nodes, seed, counter)
        edge_ends, at = np.cumsum(steps), 0
        for s, head, head_word, _, _, word, value, _ in todo:
            n = len(word)
            lo = int(edge_ends[at - 1]) if at else 0
            hi = int(edge_ends[at + n - 1]) if at + n else 0
            whole = np.concatenate([head, edges[lo:hi]])
            # The last sample is not branched off.
            whole_word = np.concatenate([head_word, np.repeat(word, steps[at : at + n])]) if sample + 1 < k else word
            at += n
            s.found(whole, whole_word, value)
        _opened([(t[0], t[3], sum(math.exp(lat.logs[g]) for g in t[7]), t[7]) for t in todo])
        if sample + 1 < k:
            todo = [(t[0], *b) for t in todo if (b := t[0].branch())]
    out = []
    for s in searches:
        limit = -s.heap[0][0] if s.heap else -math.inf
        rows = []
        for edges, _, mass, value in s.paths:
            score = 1.0 if limit == -math.inf else -math.expm1(-math.exp(min(mass - limit, 700.0)))
            rows.append((piece_ids(lat, edges), mass, value, score))
        out.append(rows)
    lat.trimmed(new)
    return out


def piece_ids(lat: Lattices, edges: np.ndarray) -> np.ndarray:
    """Ids of a path; a character spelt in several bytes gives their ids."""
    codes = lat.code[edges]
    wide = np.flatnonzero(codes >= _WIDE)
    if not len(wide):
        return codes
    byte_id = lat.vocabulary.byte_id
    spelt = [[byte_id[b] for b in chr(c ^ _WIDE).encode()] for c in codes[wide].tolist()]
    times = np.ones(len(codes), np.int64)
    times[wide] = [len(x) for x in spelt]
    out, begin = np.repeat(codes, times), np.cumsum(times) - times
    for at, ids in zip(begin[wide].tolist(), spelt, strict=True):
        out[at : at + len(ids)] = ids
    return out


def read_model(path: str = MODEL) -> bytes:
    """The model file, read by the driver and sent to the executors with the job (half a megabyte)."""
    with open(path, "rb") as f:
        return f.read()


def segmented(docs: DataFrame, k: int = SAMPLES, model: str = MODEL, decode_to: str | None = None) -> DataFrame:
    """Every column of ``docs`` but ``text``, and up to ``k`` rows a document with its sampled segmentations:
    ``rank`` (from 1, by perturbed score), ``ids array<int>``, ``log_prob``, ``gumbel``, ``inclusion``.

    Segmentations of a document are distinct; draws depend only on the row's id and text, so a retried task and a
    repeated row give the same. ``inclusion`` is the chance that the segmentation lies above the next perturbed score
    (1 if there is none). Null and empty texts have one segmentation without pieces. Every text is spelt whole: what
    the vocabulary lacks goes by bytes, so decoding gives the text back exactly; ``decode_to`` names a column for the text
    that the ids decode to (else see `decoded`). New columns replace those of the same
    name. An empty table gives an empty result.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    proto = read_model(model)
    rest = [c for c in docs.columns if c not in ("text", "rank", "ids", "log_prob", "gumbel", "inclusion", decode_to)]
    seed = "draw_seed"
    while seed in map(str.lower, docs.columns):  # a name that no column has
        seed += "_"
    rows = docs.select(*rest, F.coalesce("text", F.lit("")).alias("text"), row_key().alias(seed))

    names = [*rest, "rank", "ids", "log_prob", "gumbel", "inclusion", *([decode_to] if decode_to else [])]

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of this task alone: a worker keeps nothing of it in memory afterwards.
        lat = Lattices(Vocabulary(proto))
        for b in batches:
            texts, seeds = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_numpy().view(np.uint64).tolist()
            begin, size = 0, 0
            for i, text in enumerate(texts):
                size += len(text)
                if size >= BATCH_CHARS or i + 1 == len(texts):
                    yield made(b.slice(begin, i + 1 - begin), sampled(lat, texts[begin : i + 1], seeds[begin : i + 1], k), lat.vocabulary)
                    begin, size = i + 1, 0

    def made(b: pa.RecordBatch, found: list, vocabulary: Vocabulary) -> pa.RecordBatch:
        which = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
        flat = [(n + 1, *f) for rows in found for n, f in enumerate(rows)]
        offsets = np.zeros(len(flat) + 1, np.int32)
        np.cumsum([len(f[1]) for f in flat], out=offsets[1:])
        values = np.concatenate([f[1] for f in flat]) if flat else np.zeros(0, np.int32)
        cols = [b.column(c).take(which) for c in rest]
        cols += [pa.array([f[0] for f in flat], pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))]
        cols += [pa.array([f[i] for f in flat], pa.float64()) for i in (2, 3, 4)]
        if decode_to:
            cols.append(pa.array(decode_all(vocabulary, values, offsets), pa.string()))
        return pa.RecordBatch.from_arrays(cols, names)

    kind = StructType([docs.schema[c] for c in rest]).add("rank", IntegerType()).add("ids", ArrayType(IntegerType()))
    for name in ("log_prob", "gumbel", "inclusion"):
        kind = kind.add(name, DoubleType())
    kind = kind.add(decode_to, StringType()) if decode_to else kind
    return rows.mapInArrow(sample, kind)


def decode(vocabulary: Vocabulary, ids: list[int]) -> str:
    """The text of piece ids: marks become spaces, the leading one goes, bytes that form no character become U+FFFD."""
    text = b"".join(map(vocabulary.out.__getitem__, ids))
    return (text[1:] if text[:1] == b" " else text).decode(errors="replace")


def decode_all(vocabulary: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The texts, as of `decode`, of runs of ids that lie behind each other."""
    spelt = vocabulary.spelt.take(pa.array(ids))
    ends, data = np.frombuffer(spelt.buffers()[1], np.int64), memoryview(spelt.buffers()[2] or b"")
    at = ends[offsets].tolist() if len(ids) else [0] * len(offsets)
    return [str(data[s + (data[s:e][:1] == b" ") : e], "utf-8", "replace") for s, e in zip(at, at[1:], strict=False)]


def decoded(rows: DataFrame, model: str = MODEL, to: str = "text") -> DataFrame:
    """``rows`` with ``ids array<int>`` decoded to a column ``to`` (null ids: null text)."""
    proto = read_model(model)
    rows = rows.drop(to)
    names = [*rows.columns, to]

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(proto)
        for b in batches:
            lists = b.column("ids")
            offsets, flat, valid = lists.offsets.to_pylist(), lists.values.to_pylist(), lists.is_valid().to_pylist()
            made = [decode(vocabulary, flat[s:e]) if v else None for s, e, v in zip(offsets, offsets[1:], valid, strict=False)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names)

    return rows.mapInArrow(text, StructType([*rows.schema]).add(to, StringType()))
