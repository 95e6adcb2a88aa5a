"""N-best segmentation with the pieces of a SentencePiece model, and decoding.

A text becomes "▁" plus the text with every space as "▁"; no piece has a
"▁" behind another character, so the piece lattice falls apart at the front of
every run of "▁" into segments, and further between any two characters that no
piece has next to each other. For each part a forward Viterbi pass gives the best
score of every prefix; these scores are the exact heuristic of an A* search that walks
back from the end, so complete paths leave its queue best first. The best segmentations
of the text combine those of its parts, again best first: an alternative that some
n-best result uses is itself among the n - 1 cheapest.

Scores are integers (millionths of a log probability): those of a unigram model as they
are; a BPE model only ranks its pieces, so their probabilities follow Zipf's law. A
character that is no piece is spelled in byte pieces. Equal scores keep the order in
which the search met them, which depends on the text alone.

Cases: a null text counts as empty and has one segmentation of no pieces; a "▁" of
the text decodes to a space, as in the reference format; repeated rows get equal
results; an empty table gives an empty result; other columns are returned as they are.

Texts are cut at spaces into chunks, which are whole segments, and every chunk is solved
once for all texts of a batch; new short ones go through the Viterbi pass side by side, as
columns of an array. Memory follows the longest text of a batch; what is remembered is
bounded.
"""

from __future__ import annotations

import heapq
import math
import re
import struct
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column
from pyspark.sql import functions as F

from sievemark.llm.common import blobs, no_collection, process_wide

SPACE = "▁"
SCALE = 1_000_000
BYTE_COST = 4.0  # of a byte piece, below the rarest piece, as a log probability
CACHE_CHUNKS = 60_000
CACHE_OTHERS = 4_000
TEXTS_AT_ONCE = 512
BYTES_AT_ONCE = 1 << 20
LONGEST_CACHED = 64
SIDE_BY_SIDE = 32  # longest text of a column pass
FEWEST_COLUMNS = 32
MOST_COLUMNS = 8_192
CODE_BITS = 21  # of a character
SPREAD = np.uint64(0x9E3779B97F4A7C15)
NEVER = np.iinfo(np.int64).max
UNREACHED = np.iinfo(np.int64).min // 2
CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*")

RESULT = (
    "ids binary, n_pieces bigint, n_bytes_spelled bigint, scores array<bigint>, "
    "alternatives array<array<struct<at:bigint,length:bigint,ids:binary>>>"
)


def packed(*ids: int) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def char_class(chars: Iterable[str]) -> str:
    """A pattern for one of the characters, empty for none."""
    listed = "".join(re.escape(c) for c in sorted(chars))
    return f"[{listed}]" if listed else ""


class Vocabulary:
    """The names and kinds of the pieces of a model."""

    def __init__(self, model: sentencepiece.SentencePieceProcessor) -> None:
        size = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = [i for i in range(size) if model.is_byte(i)]
        self.byte_of = {i: int(self.names[i][1:-1], 16) for i in self.byte_ids}
        self.hidden = {i for i in range(size) if model.is_control(i)}

    def texts(self) -> np.ndarray:
        """What every id decodes to, in bytes; control ids to nothing."""
        table = np.full(len(self.names), b"", object)
        for i, name in enumerate(self.names):
            if i in self.byte_of:
                table[i] = bytes([self.byte_of[i]])
            elif i not in self.hidden:
                table[i] = name.replace(SPACE, " ").encode()
        return table


class Pieces(Vocabulary):
    """The pieces of a model with their ids and scores."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        super().__init__(model)
        size = len(self.names)
        plain = [
            i
            for i in range(size)
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        scores = [model.get_score(i) for i in plain]
        # A BPE model numbers its merges 0, -1, -2 ...; log probabilities are not whole.
        ranked = all(s == int(s) for s in scores)
        logs = [-math.log(2 - s) for s in scores] if ranked else scores
        rarest = -math.log(size) if ranked else min(scores, default=0.0)
        self.byte_score = round((rarest - BYTE_COST) * SCALE)
        self.unknown = model.unk_id()
        known = {
            self.names[i]: (i, round(s * SCALE)) for i, s in zip(plain, logs, strict=True)
        }
        # Pieces from their last character on: (packed id and score, what may precede).
        self.tree: dict[str, list] = {}
        for name, (i, score) in known.items():
            level = self.tree
            for char in reversed(name):
                node = level.setdefault(char, [None, {}])
                level = node[1]
            node[0] = (packed(i), score)
        self.neighbours = {name[k : k + 2] for name in known for k in range(len(name) - 1)}
        chars = set("".join(known)) - {SPACE}
        joined = {pair[1] for pair in self.neighbours if pair[0].isalnum()}
        # Where a word meets a mark that no piece has behind a letter, no edge passes.
        words = char_class(c for c in chars if c.isalnum())
        self.chars, self.loose = chars, {c for c in chars if not c.isalnum() and c not in joined}
        loose = char_class(self.loose)
        word = f"{SPACE}*{words}++(?={loose})|" if words and loose else ""
        # A character of no piece stands alone between segments.
        self.segment = re.compile(f"{word}{SPACE}*{char_class(chars)}+|{SPACE}+|[^{SPACE}]")
        if any(SPACE in p.lstrip(SPACE) for p in known):
            raise ValueError("pieces that go on behind a space are not supported")

    def spelled(self, char: str) -> tuple[bytes, int, int]:
        """Packed ids, score and number of the byte pieces of a character."""
        data = char.encode("utf-8", "replace")
        if not self.byte_ids:
            return packed(self.unknown), self.byte_score, 0
        return packed(*[self.byte_ids[b] for b in data]), self.byte_score * len(data), len(data)

    def edges(self, text: str) -> list[list[tuple[int, bytes, int]]]:
        """For every end, the (start, packed ids, score) of the edges that end there,
        by start."""
        into: list[list[tuple[int, bytes, int]]] = [[]]
        for end in range(1, len(text) + 1):
            level, found = self.tree, []
            for start in range(end - 1, -1, -1):
                node = level.get(text[start])
                if node is None:  # no piece ends like this
                    break
                if node[0] is not None:
                    found.append((start, *node[0]))
                level = node[1]
            if not found or found[0][0] != end - 1:
                found.insert(0, (end - 1, *self.spelled(text[end - 1])[:2]))
            into.append(found[::-1])
        return into

    def parts(self, text: str) -> list[str]:
        """``text`` cut where no edge of its lattice passes. A plain word is not looked
        at: cutting it would not make it easier to remember."""
        if text[1:].isalpha():
            return [text]
        joined = self.neighbours
        cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in joined]
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]

    def best_of_all(self, texts: Iterable[str]) -> dict[str, tuple[bytes, int, int, int]]:
        """Of every text packed ids and score of the best segmentation, what the second
        best costs, and the number of byte pieces.

        A Viterbi pass goes from left to right, so texts in order share the passes over
        their common beginnings. Seen from the end, the second best leaves the best path
        at one place, by an edge behind which it is the best again.
        """
        found, last = {}, ""
        first, second, back = [0], [UNREACHED], [()]
        for text in sorted(texts):
            known = 0
            for one, other in zip(last, text, strict=False):
                if one != other:
                    break
                known += 1
            del first[known + 1 :], second[known + 1 :], back[known + 1 :]
            for end in range(known + 1, len(text) + 1):
                level, top, next_top, way = self.tree, UNREACHED, UNREACHED, ()
                start = end - 1
                node = level.get(text[start])
                if node is None or node[0] is None:
                    ids, score, spelled = self.spelled(text[start])
                    top, way = first[start] + score, (start, ids, spelled)
                while node is not None:
                    piece, level = node
                    if piece is not None:
                        score = first[start] + piece[1]
                        if score >= top:  # of equal ones that with the longest last piece
                            next_top, top, way = top, score, (start, piece[0], 0)
                        elif score > next_top:
                            next_top = score
                    start -= 1
                    node = level.get(text[start]) if start >= 0 else None
                first.append(top)
                second.append(next_top)
                back.append(way)
            last = text
            cost, place, path, total = NEVER, len(text), [], 0
            while place:
                if second[place] != UNREACHED and first[place] - second[place] < cost:
                    cost = first[place] - second[place]
                place, ids, spelled = back[place]
                path.append(ids)
                total += spelled
            path.reverse()
            found[text] = (b"".join(path), first[-1], cost, total)
        return found

    def n_best(self, text: str, n: int) -> list[tuple[int, bytes]]:
        """The ``n`` best (score, packed ids) of a segment, best first."""
        into = self.edges(text)
        best = [0] * (len(text) + 1)
        for end in range(1, len(text) + 1):
            best[end] = max(best[start] + score for start, _, score in into[end])
        order = count(0, -1)  # of equal scores the latest: depth first, as ``best`` goes
        # (minus the score of the best path through it, order, place, score behind, path)
        queue = [(-best[-1], next(order), len(text), 0, None)]
        visits = [0] * (len(text) + 1)
        results = []
        while queue and len(results) < n:
            _, _, place, behind, path = heapq.heappop(queue)
            if place == 0:
                ids = []
                while path is not None:
                    ids.append(path[0])
                    path = path[1]
                results.append((behind, b"".join(ids)))
                continue
            if visits[place] == n:  # n better ways from here to the end are known
                continue
            visits[place] += 1
            for start, ids, score in reversed(into[place]):
                total = behind + score
                heapq.heappush(queue, (-(best[start] + total), next(order), start, total, (ids, path)))
        return results


class Columns:
    """``Pieces.best_of_all`` for many short texts side by side: step by step the ends of
    all texts, and from there back through the pieces, the nodes of which lie in a hash
    table by node above and character."""

    def __init__(self, tree: dict[str, list]) -> None:
        edges, ids, scores, walk = [], [-1], [0], [(0, tree)]
        while walk:
            above, level = walk.pop()
            for char, (piece, below) in level.items():
                edges.append((above << CODE_BITS | ord(char), len(ids)))
                walk.append((len(ids), below))
                ids.append(struct.unpack("<I", piece[0])[0] if piece else -1)
                scores.append(piece[1] if piece else 0)
        self.ids, self.scores = np.array(ids, np.int64), np.array(scores, np.int64)
        keys, nodes = np.array(edges, np.int64).reshape(-1, 2).T
        bits = (4 * len(keys) + 4).bit_length()
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.nodes = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        places, left = self.places(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[places[left]] < 0]
            self.keys[places[free]] = keys[free]
            left = left[self.keys[places[left]] != keys[left]]
            places[left] = (places[left] + 1) & self.last
        self.nodes[places] = nodes

    def places(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * SPREAD) >> self.shift).astype(np.int64)

    def below(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The nodes below by the characters given, 0 for none."""
        keys = nodes << CODE_BITS | chars
        places = self.places(keys)
        met = self.keys[places]
        left = np.flatnonzero((met != keys) & (met >= 0))
        while len(left):
            places[left] = (places[left] + 1) & self.last
            met[left] = self.keys[places[left]]
            left = left[(met[left] != keys[left]) & (met[left] >= 0)]
        return np.where(met == keys, self.nodes[places], 0).astype(np.int64)

    def fit(self, texts: list[str]) -> np.ndarray:
        """Whether the texts are short and all their characters are pieces."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        chars, place = np.unique(codes(texts), return_inverse=True)
        alone = self.ids[self.below(np.zeros(len(chars), np.int64), chars)] >= 0
        missing = np.concatenate([[0], np.cumsum(~alone[place])])
        ends = np.cumsum(sizes)
        return (sizes <= SIDE_BY_SIDE) & (missing[ends] == missing[ends - sizes])

    def best(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the best segmentations one behind the other, and for every text their
        number, the score, and what the second best costs."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-sizes, kind="stable")
        counts, scores, seconds = (np.empty(len(texts), np.int64) for _ in range(3))
        steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for low in range(0, len(texts), MOST_COLUMNS):
            some = order[low : low + MOST_COLUMNS]
            of, behind, ids, counts[some], scores[some], seconds[some] = self.passed(
                [texts[i] for i in some.tolist()], sizes[some]
            )
            steps.append((some[of], behind, ids))
        of, behind, ids = (np.concatenate(x) for x in zip(*steps, strict=True))
        packed_ids = np.empty(len(ids), "<u4")
        packed_ids[np.cumsum(counts)[of] - 1 - behind] = ids
        return packed_ids, counts, scores, seconds

    def passed(self, texts: list[str], sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """The pass over texts in descending order of ``sizes``: of every piece of a best
        path the text, the number of pieces behind it and its id, then counts, scores and
        costs of the second best by text."""
        most = int(sizes[0])
        inside = np.arange(most) < sizes[:, None]
        grid = np.zeros(inside.shape, np.int64)
        grid[inside] = codes(texts)
        grid = np.ascontiguousarray(grid.T)
        first = np.zeros((most + 1, len(texts)), np.int64)
        second = np.full((most + 1, len(texts)), UNREACHED, np.int64)
        length = np.zeros((most + 1, len(texts)), np.int8)
        piece = np.zeros((most + 1, len(texts)), np.int32)
        for end in range(1, most + 1):
            some = np.arange(int(np.searchsorted(-sizes, -end, "right")))
            node = self.below(np.zeros(len(some), np.int64), grid[end - 1, some])
            top, next_top = np.full(len(some), UNREACHED, np.int64), second[end]
            for back in range(1, end + 1):
                found = self.ids[node]
                hit = np.flatnonzero(found >= 0)
                at = some[hit]
                score, best = first[end - back, at] + self.scores[node[hit]], top[at]
                better = score >= best  # of equal ones that with the longest last piece
                next_top[at] = np.where(better, best, np.maximum(next_top[at], score))
                won = at[better]
                top[won] = score[better]
                length[end, won] = back
                piece[end, won] = found[hit[better]]
                if back == end:
                    break
                node = self.below(node, grid[end - back - 1, some])
                on = np.flatnonzero(node)
                if not len(on):
                    break
                some, node = some[on], node[on]
            first[end, : len(top)] = top
        counts, cost = np.zeros(len(texts), np.int64), np.full(len(texts), NEVER, np.int64)
        of, place, steps, number = np.arange(len(texts)), sizes.copy(), [], 0
        while len(of):
            near = second[place, of]
            cost[of] = np.where(near == UNREACHED, cost[of], np.minimum(cost[of], first[place, of] - near))
            steps.append((of, np.full(len(of), number), piece[place, of]))
            counts[of] += 1
            place = place - length[place, of]
            of, place, number = of[place > 0], place[place > 0], number + 1
        return *map(np.concatenate, zip(*steps, strict=True)), counts, first[sizes, np.arange(len(texts))], cost


def codes(texts: list[str]) -> np.ndarray:
    """The characters of all texts, as numbers."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)


def decoding_table(path: str) -> np.ndarray:
    return Vocabulary(sentencepiece.SentencePieceProcessor(model_file=path)).texts()


def decode(packed: bytes, table: np.ndarray) -> str:
    """The text of packed ids, without the space put in front; bytes that are no UTF-8
    become U+FFFD."""
    parts = table[np.frombuffer(packed, "<u4")].tolist()
    return b"".join(parts).removeprefix(b" ").decode("utf-8", "replace")


class Remembered:
    """The best segmentations of texts by number: ids one text behind the other, and a row
    of (place of the ids, their number, score, cost of the second best, byte pieces,
    uses) for each."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.names: list[str] = []
        self.ids, self.n_ids = np.empty(1024, "<u4"), 0
        self.rows = np.empty((1024, 6), np.int64)

    def add(self, texts: list[str], ids: np.ndarray, *facts: np.ndarray) -> None:
        """Add new ``texts`` with the ids of all of them and their number, score, cost of
        the second best and byte pieces."""
        low, high = len(self.names), len(self.names) + len(texts)
        self.number.update(zip(texts, range(low, high), strict=True))
        self.names += texts
        self.ids = grown(self.ids, self.n_ids + len(ids))
        self.rows = grown(self.rows, high)
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        for column, values in enumerate(facts, 1):
            self.rows[low:high, column] = values
        self.rows[low:high, 0] = self.n_ids + np.cumsum(facts[0]) - facts[0]
        self.rows[low:high, 5] = 1
        self.n_ids += len(ids)

    def numbers(self, texts: Sequence[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, texts), np.int64, len(texts))

    def ids_of(self, rows: np.ndarray) -> np.ndarray:
        """The ids of some rows, one behind the other."""
        start, size = rows[:, 0], rows[:, 1]
        ends = np.cumsum(size)
        return self.ids[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]

    def trimmed(self, most: int) -> Remembered:
        """The short texts used most, of equal ones the latest."""
        rows = self.rows[: len(self.names)]
        short = np.fromiter(map(len, self.names), np.int64, len(rows)) <= LONGEST_CACHED
        uses = np.where(short, rows[:, 5], 0)
        best = np.sort(np.argsort(uses, kind="stable")[-most:])
        best = best[uses[best] > 0]
        kept, rows = Remembered(), rows[best]
        kept.add([self.names[i] for i in best.tolist()], self.ids_of(rows), *rows[:, 1:5].T)
        kept.rows[: len(best), 5] = (rows[:, 5] + 1) // 2
        return kept


def grown(array: np.ndarray, size: int) -> np.ndarray:
    """``array`` with room for ``size`` rows."""
    if size <= len(array):
        return array
    larger = np.empty((max(size, 2 * len(array)), *array.shape[1:]), array.dtype)
    larger[: len(array)] = array
    return larger


class Segmenter:
    """N-best segmentations of whole texts.

    Best segmentations of chunks, segments and parts are remembered; once there are too
    many, the less used ones go. The further segmentations of a part are searched for only
    where its second best is among the cheapest changes of a whole text.
    """

    def __init__(self, path: str, n: int) -> None:
        self.pieces, self.n = Pieces(path), n
        self.columns = Columns(self.pieces.tree)
        self.known = Remembered()
        self.others: dict[str, list[tuple[int, bytes]]] = {}

    def learn(self, texts: Iterable[str]) -> None:
        """Make all of the texts known; each is a row of whole segments or a part."""
        pieces, number = self.pieces, self.known.number
        new = [text for text in dict.fromkeys(texts) if text not in number]
        # Segments end between letters and a loose mark.
        cut = {t: [t[:-1], t[-1]] for t in new if t[-1] in pieces.loose and t[1:-1].isalpha()}
        if cut:
            self.learn(part for parts in cut.values() for part in parts)
            new = [text for text in new if text not in cut]
        # A word of letters that are pieces is one segment and one part.
        alone = {}
        for text in self.solved([text for text in new if text[1:].isalpha()]) + [
            text for text in new if not text[1:].isalpha()
        ]:
            segments = pieces.segment.findall(text)
            parts = [p for s in segments for p in pieces.parts(s)]
            if len(parts) == 1:
                alone[text] = None
            else:
                cut[text] = parts
                alone.update(dict.fromkeys(parts))
        rest = self.solved([text for text in alone if text not in number])
        if rest:
            found = pieces.best_of_all(rest)
            ids, scores, seconds, spelled = zip(*found.values(), strict=True)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            self.known.add(list(found), np.frombuffer(b"".join(ids), "<u4"), sizes, scores, seconds, spelled)
        cut = {text: parts for text, parts in cut.items() if text not in number}
        if cut:
            sizes = np.fromiter(map(len, cut.values()), np.int64, len(cut))
            rows = self.known.rows[self.known.numbers([p for parts in cut.values() for p in parts])]
            starts = np.cumsum(sizes) - sizes
            total = np.add.reduceat(rows, starts)
            cost = np.minimum.reduceat(rows[:, 3], starts)
            self.known.add(list(cut), self.known.ids_of(rows), total[:, 1], total[:, 2], cost, total[:, 4])

    def solved(self, texts: list[str]) -> list[str]:
        """Make those of the texts known that fit a pass side by side; the others."""
        if len(texts) < FEWEST_COLUMNS:
            return texts
        fit = self.columns.fit(texts)
        short = [texts[i] for i in np.flatnonzero(fit).tolist()]
        if short:
            self.known.add(short, *self.columns.best(short), np.zeros(len(short), np.int64))
        return [texts[i] for i in np.flatnonzero(~fit).tolist()]

    def other_parts(self, text: str) -> list[tuple[int, bytes]]:
        """(cost, packed ids) of the second to n-th best of a part."""
        if text not in self.others:
            if len(self.others) >= CACHE_OTHERS:
                self.others.clear()
            (score, _), *rest = self.pieces.n_best(text, self.n)
            self.others[text] = [(score - s, ids) for s, ids in rest]
        return self.others[text]

    def other_segments(self, text: str) -> list[tuple[int, bytes]]:
        """The same of a segment."""
        parts = self.pieces.parts(text)
        if len(parts) == 1:
            return self.other_parts(text)
        self.learn(parts)
        rows = self.known.rows[self.known.numbers(parts)]
        found = [self.known.ids[a : a + size].tobytes() for a, size in rows[:, :2].tolist()]
        places, combos = self.combined(parts, rows[:, 3].tolist(), self.other_parts)
        others = []
        for cost, chosen in combos[1:]:
            ids = list(found)
            for p, k in chosen:
                ids[p] = places[p][k][1]
            others.append((cost, b"".join(ids)))
        return others

    def chunks(self, texts: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """The numbers of the chunks of all texts, and how many chunks each text has."""
        mark = SPACE.encode()
        # Where every space stands alone, Arrow cuts the texts and finds equal chunks.
        # A line break of no piece begins a chunk, too, after a zero in place of the space.
        plain = [t.replace(mark, b" ") for t in texts]
        if "\n" not in self.pieces.chars:
            plain = [t if b"\0" in t else t.replace(b"\n", b" \0\n") for t in plain]
        even = [
            bool(t) and b"\0" not in t and b"  " not in p and p[:1] != b" " and p[-1:] != b" "
            for t, p in zip(texts, plain, strict=True)
        ]
        split = pc.split_pattern(pa.array([p for p, e in zip(plain, even, strict=True) if e], pa.binary()), " ")
        coded = split.flatten().dictionary_encode()
        names = [c.decode("utf-8", "replace") for c in coded.dictionary.to_pylist()]
        names = [c[1:] if c[0] == "\0" else SPACE + c for c in names]
        lengths = iter(pc.list_value_length(split).to_pylist())
        firsts = iter([0, *np.cumsum(pc.list_value_length(split).to_numpy()).tolist()])
        flat, places, sizes = coded.indices.to_numpy(), [], []
        for text, e in zip(texts, even, strict=True):
            if e:
                first, size = next(firsts), next(lengths)
                places.append(flat[first : first + size])
            else:
                some = CHUNK.findall(SPACE + text.decode("utf-8", "replace").replace(" ", SPACE)) if text else []
                size = len(some)
                places.append(np.arange(len(names), len(names) + size))
                names += some
            sizes.append(size)
        self.learn(names)
        return self.known.numbers(names)[np.concatenate(places)], sizes

    def of_all(self, texts: list[bytes]) -> list[tuple]:
        """The result columns of some texts."""
        if not texts:
            return []
        with no_collection():
            numbers, sizes = self.chunks(texts)
            used = np.unique(numbers)
            self.known.rows[used, 5] += 1
            ids = self.known.ids_of(self.known.rows[numbers, :2])
            seconds = self.known.rows[numbers, 3]
            # Numbers of ids, scores and byte pieces of everything in front of a chunk.
            before = np.zeros((len(numbers) + 1, 3), np.int64)
            for column, fact in enumerate((1, 2, 4)):
                np.cumsum(self.known.rows[numbers, fact], out=before[1:, column])
            results, low = [], 0
            for size in sizes:
                high = low + size
                results.append(self.of_chunks(numbers[low:high], seconds[low:high], before[low : high + 1], ids))
                low = high
            if len(self.known.names) > CACHE_CHUNKS:
                self.known = self.known.trimmed(CACHE_CHUNKS // 2)
        return results

    def of(self, text: bytes) -> tuple:
        return self.of_all([text])[0]

    def of_chunks(self, numbers: np.ndarray, seconds: np.ndarray, before: np.ndarray, ids: np.ndarray) -> tuple:
        """The result columns of a text; ``ids`` are those of all texts, ``before`` has the
        sums in front of its chunks."""
        if not len(numbers):
            return b"", 0, 0, [0], [[]]
        size, score, spelled = (before[-1] - before[0]).tolist()
        # The cheapest segments lie in the cheapest chunks.
        segments, costs, at = [], [], []
        for p in self.cheapest(seconds):
            if seconds[p] == NEVER:
                continue
            name, start = self.known.names[numbers[p]], int(before[p, 0] - before[0, 0])
            some = self.pieces.segment.findall(name)
            if len(some) == 1:
                facts = [(int(before[p + 1, 0] - before[p, 0]), int(seconds[p]))]
            else:
                self.learn(some)
                facts = self.known.rows[self.known.numbers(some)][:, [1, 3]].tolist()
            for segment, (length, cost) in zip(some, facts, strict=True):
                segments.append(segment)
                costs.append(cost)
                at.append((start, length))
                start += length
        others, combos = self.combined(segments, costs, self.other_segments)
        alternatives = [
            [
                {"at": at[p][0], "length": at[p][1], "ids": others[p][k][1]}
                for p, k in sorted(chosen)
            ]
            for _, chosen in combos
        ]
        packed_ids = ids[before[0, 0] : before[-1, 0]].tobytes()
        return packed_ids, size, spelled, [score - c for c, _ in combos], alternatives

    def cheapest(self, seconds: Sequence[int]) -> list[int]:
        """The places of the ``n - 1`` smallest costs, of equal ones the first."""
        n = self.n
        if len(seconds) < n:
            return list(range(len(seconds)))
        costs = np.asarray(seconds, np.int64)
        limit = np.partition(costs, n - 2)[n - 2]
        below = np.flatnonzero(costs < limit)
        equal = np.flatnonzero(costs == limit)[: n - 1 - len(below)]
        return np.sort(np.concatenate([below, equal])).tolist()

    def combined(
        self, texts: Sequence[str], seconds: Sequence[int], search: Callable[[str], list]
    ) -> tuple[dict[int, list], list[tuple[int, tuple]]]:
        """The others at the places that matter, and the ``n`` cheapest combinations
        (cost, ((place, choice), ...)), the best itself first."""
        n = self.n
        others = {p: search(texts[p]) for p in self.cheapest(seconds) if seconds[p] != NEVER}
        singles = sorted(
            (cost, p, k) for p, more in others.items() for k, (cost, _) in enumerate(more)
        )[: n - 1]
        queue: list[tuple[int, tuple, int]] = [(0, (), 0)]
        results = []
        while queue and len(results) < n:
            cost, chosen, after = heapq.heappop(queue)
            results.append((cost, chosen))
            taken = {p for p, _ in chosen}
            for j in range(after, len(singles)):
                more, p, k = singles[j]
                if p not in taken:
                    heapq.heappush(queue, (cost + more, (*chosen, (p, k)), j + 1))
        return others, results


def _binary(texts: pa.Array) -> list[bytes]:
    return [t or b"" for t in blobs(texts)]


def _groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in order, so many at once; one empty group for none."""
    held, size = [], 0
    for text in texts:
        if held and (len(held) == TEXTS_AT_ONCE or size + len(text) > BYTES_AT_ONCE):
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    yield held


def n_best_pieces(text: Column, model: str, n: int = 4) -> Column:
    """For ``n`` of 2 or more a struct column: ``ids`` of the best segmentation (little-endian unsigned 32-bit
    integers), their number, how many are byte pieces, the ``scores`` of the up to ``n``
    best, and for each the segments in which it differs from the best: ``length`` ids
    from ``at`` on become ``ids``."""
    change = pa.struct([("at", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.list_(change)))
    names = ("ids", "n_pieces", "n_bytes_spelled", "scores", "alternatives")

    @F.arrow_udf(RESULT)
    def segmented(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # Goes with its task: workers take turns, and idle ones would hold one each.
        segmenter = Segmenter(model, n)
        for batch in batches:
            for texts in _groups(_binary(batch)):
                rows = segmenter.of_all(texts)
                columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.StructArray.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names)
                )

    return segmented.asNondeterministic()(text)  # so that it is not computed twice


def decoded_pieces(ids: Column, model: str) -> Column:
    """The text of packed ids; null counts as no ids."""

    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = process_wide(("pieces", model), lambda: decoding_table(model))
        for batch in batches:
            for first in range(0, max(1, len(batch)), TEXTS_AT_ONCE):
                some = batch.slice(first, TEXTS_AT_ONCE).to_pylist()
                yield pa.array([decode(x or b"", table) for x in some], pa.string())

    return decoded(ids)
