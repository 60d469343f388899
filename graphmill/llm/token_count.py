"""Token counts by a tokenizer that is compiled to a deterministic transducer over characters.

The tokens of a byte-pair tokenizer are the one way to cut a text so that every two neighbours, put together, are cut
into the same two.  So the last token of every prefix is found from the last tokens of the prefixes before it, and no
more of them matter than the longest run of characters that a token may still continue.  That is a state: the run, and
for each place in it the last token there and how many tokens fewer there were.  Its transition under a character says
by how many the count of tokens changes, which may be negative, as a longer token can take the place of shorter ones.

Transitions are determinised when first met and kept in a hash table of numpy arrays, so a step of all lanes is a few
array operations.  Texts are cut into lanes of LANE characters.  Each lane has a state map: from a state at its start
to the state at its end and the tokens emitted.  A map is first made for the state that BACK characters before the
lane lead to, then for every end of the lane before it that the map lacks, until it lacks none.  Maps then compose by
a parallel prefix scan: in each round every composed map is put together with the one as many lanes further on, so a
text of n lanes takes log2(n) rounds.  Lanes never span texts.

Rows are judged one by one in the task that reads them: no shuffle, no state between tasks but the table of
transitions, which a worker forgets beyond MOST_STATES.  A very long text is taken in slabs of SLAB characters, with the
state handed on, so memory is bounded by SLAB and the batch.

Null and empty texts have no tokens and no bytes.  Rows that are equal or repeat an id come out as often as they are
there, a null id stays null, an empty table gives an empty result, and extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import exclusive, map_arrow

LIMIT = 4096
LANE, BACK, SLAB = 256, 24, 1 << 21
#: States that a worker knows before it starts anew.
MOST_STATES = 300_000
SPACE, SPACE_CODE = "▁", 0x2581
#: A transition is stored as (state << SHIFT) + emitted + HALF.
SHIFT, HALF = 12, 1 << 11
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """What a sentencepiece model of byte pairs says: pieces with scores, how it merges, what its tokens weigh."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        if any(model.is_unused(i) for i in ids) or sum(model.is_byte(i) for i in ids) != 256:
            raise ValueError(f"{path}: only models with byte fallback and without unused pieces can be compiled")
        self.score = {model.id_to_piece(i): model.get_score(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        self.prefixes = {p[:n] for p in self.score for n in range(1, len(p))}
        self.inside = {p[n : n + 2] for p in self.score for n in range(len(p) - 1)}
        self.longest = max(map(len, self.score))
        self._pairs: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}
        # What the compiled form takes for granted: one space before, each space its own mark, nothing else changed.
        for probe in ("a", "  a b  ", "é\t\n\r　ﬁ", "<s></s>"):
            if "".join(model.encode(probe, out_type=str)).replace("<0x09>", "\t").replace("<0x0A>", "\n").replace("<0x0D>", "\r") != SPACE + probe.replace(" ", SPACE):
                raise ValueError(f"{path}: texts are normalised")

    def merge(self, text: str) -> list[str]:
        """The tokens of a short text: the best-scored neighbours merge first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def is_token(self, text: str) -> bool:
        if text not in self._whole:
            self._whole[text] = len(text) == 1 or (text in self.score and len(self.merge(text)) == 1)
        return self._whole[text]

    def stand(self, left: str, right: str) -> bool:
        """Whether two tokens stay as they are next to each other."""
        if left[-1] + right[0] not in self.inside:
            return True
        key = (left, right)
        if key not in self._pairs:
            self._pairs[key] = self.merge(left + right) == [left, right]
        return self._pairs[key]

    def weight(self, token: str) -> int:
        """Ids that a token gives: a character that is no piece gives its bytes."""
        return 1 if token in self.score else len(token.encode())


class Transducer:
    """States and transitions as far as texts have asked for them."""

    def __init__(self, path: str) -> None:
        self.pieces = Pieces(path)
        self.forget()

    def forget(self) -> None:
        self.keys: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.bits, self.held = 16, 0
        self.at = np.full(1 << self.bits, -1, np.int64)
        self.to = np.zeros(1 << self.bits, np.int64)
        # What a pair was found to be is known again by merging.
        self.pieces._pairs.clear()
        self.root = self.number(("", ((None, 0),)))

    def number(self, key: tuple) -> int:
        n = self.numbers.setdefault(key, len(self.keys))
        if n == len(self.keys):
            self.keys.append(key)
        return n

    def step(self, key: tuple, c: str) -> tuple[tuple, int]:
        """The state after a character, and by how many the count of tokens changes."""
        run, lasts = key
        longer, p = run + c, self.pieces
        for k, (last, fewer) in enumerate(lasts):
            token = longer[k:]
            if p.is_token(token) and (last is None or p.stand(last, token)):
                break
        else:
            raise AssertionError(f"no token ends {longer!r}")
        emitted = p.weight(token) - fewer
        cut = next((k for k in range(len(longer)) if longer[k:] in p.prefixes), len(longer))
        kept = []
        for k in range(cut, len(longer)):
            last, fewer = lasts[k]
            # Where no token spans the place, what came before it does not matter.
            if last is not None and last[-1] + longer[k] not in p.inside:
                last = None
            kept.append((last, fewer + emitted))
        return (longer[cut:], (*kept, (token, 0))), emitted

    def _slots(self, asked: np.ndarray) -> np.ndarray:
        return ((asked.view(np.uint64) * _FACTOR) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the asked transitions, or of where they belong; and which of them are missing."""
        slot = self._slots(asked)
        held = self.at[slot]
        other = np.flatnonzero(held != asked)
        missing = []
        mask = (1 << self.bits) - 1
        while len(other):
            empty = held[other] == -1
            missing.append(other[empty])
            other = other[~empty]
            slot[other] = (slot[other] + 1) & mask
            held[other] = self.at[slot[other]]
            other = other[held[other] != asked[other]]
        return slot, np.concatenate(missing) if missing else other

    def _put(self, asked: np.ndarray, to: np.ndarray) -> None:
        if (self.held + len(asked)) * 3 > len(self.at):
            there = self.at != -1
            old, old_to = self.at[there], self.to[there]
            while (self.held + len(asked)) * 3 > 1 << self.bits:
                self.bits += 1
            self.at, self.to, self.held = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64), 0
            self._put(old, old_to)
        mask = (1 << self.bits) - 1
        slots = self._slots(asked)
        left = np.arange(len(asked))
        while len(left):
            free = left[self.at[slots[left]] == -1]
            self.at[slots[free]] = asked[free]  # of several that want one slot the last is in
            done = free[self.at[slots[free]] == asked[free]]
            self.to[slots[done]] = to[done]
            left = left[self.at[slots[left]] != asked[left]]
            slots[left] = (slots[left] + 1) & mask
        self.held += len(asked)

    def advance(self, states: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One character for each state: the states after it and the changes of the counts."""
        asked = (states << 21) | codes
        slot, missing = self._find(asked)
        if len(missing):
            new = np.unique(asked[missing])
            to = []
            for x in new.tolist():
                key, emitted = self.step(self.keys[x >> 21], chr(x & 0x1FFFFF))
                to.append((self.number(key) << SHIFT) + emitted + HALF)
            self._put(new, np.array(to, np.int64))
            slot, _ = self._find(asked)
        to = self.to[slot]
        return to >> SHIFT, (to & (2 * HALF - 1)) - HALF

    def run(self, codes: np.ndarray, begin: np.ndarray, length: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lanes side by side: the state after each of them and the tokens it emits."""
        order = np.argsort(-length, kind="stable")
        at, state, n = begin[order], states[order], length[order]
        emitted = np.zeros(len(at), np.int64)
        active = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), "left")  # lanes longer than t
        for t, some in enumerate(active.tolist()):
            state[:some], more = self.advance(state[:some], codes[at[:some] + t])
            emitted[:some] += more
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], emitted[back]


def scan(maps: tuple[np.ndarray, np.ndarray, np.ndarray], chained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Compose state maps by doubling: for each entry the state at its chain's end and the tokens from it on.

    maps: entries sorted by (lane, start state) as (lane << 32 | start, end, tokens); chained: whether a lane goes on in
    the next one.  The entry that follows another is the one of the next lane that starts with its end.
    """
    key, end, tokens = maps
    lane = key >> 32
    after = np.searchsorted(key, (lane + 1) << 32 | end)
    nowhere = len(key)
    after = np.append(np.where(chained[lane], after, nowhere), nowhere)
    end, tokens = np.append(end, -1), np.append(tokens, 0)
    while (after[:-1] != nowhere).any():
        tokens = tokens + tokens[after]
        end = np.where(after != nowhere, end[after], end)
        after = after[after]
    return end[:-1], tokens[:-1]


def lane_maps(machine: Transducer, codes: np.ndarray, begin: np.ndarray, length: np.ndarray, chained: np.ndarray, first: np.ndarray, states: np.ndarray):
    """State maps of lanes, complete under composition.  first: lanes whose state at the start is known, and states are these."""
    start = np.empty(len(begin), np.int64)
    start[first] = states
    guessed = np.setdiff1d(np.arange(len(begin)), first)
    if len(guessed):
        start[guessed], _ = machine.run(codes, begin[guessed] - BACK, np.full(len(guessed), BACK), np.full(len(guessed), machine.root))
    key = np.arange(len(begin)) << 32 | start
    end, tokens = machine.run(codes, begin, length, start)
    new_key, new_end = key, end
    while True:
        goes_on = chained[new_key >> 32]
        asked = np.unique((((new_key >> 32) + 1) << 32 | new_end)[goes_on])
        there = np.searchsorted(key, asked)
        asked = asked[(there == len(key)) | (key[np.minimum(there, len(key) - 1)] != asked)]
        if not len(asked):
            return key, end, tokens
        lane = asked >> 32
        new_key = asked
        new_end, more = machine.run(codes, begin[lane], length[lane], asked & 0xFFFFFFFF)
        key, end, tokens = np.append(key, asked), np.append(end, new_end), np.append(tokens, more)
        order = np.argsort(key, kind="stable")
        key, end, tokens = key[order], end[order], tokens[order]


def count_slab(machine: Transducer, codes: np.ndarray, sizes: list[int], carried: tuple | None) -> tuple[np.ndarray, tuple]:
    """Tokens of texts of these sizes, side by side in codes, and the last one's state; the first text goes on from a carried state."""
    sizes = np.array(sizes, np.int64)
    lanes = (sizes + LANE - 1) // LANE
    first = np.cumsum(lanes) - lanes
    text = np.repeat(np.arange(len(sizes)), lanes)
    within = np.arange(len(text)) - first[text]
    begin = (np.cumsum(sizes) - sizes)[text] + within * LANE
    length = np.minimum(LANE, sizes[text] - within * LANE)
    states = np.full(len(sizes), machine.root)
    if carried is not None:
        states[0] = machine.number(carried)
    maps = lane_maps(machine, codes, begin, length, within + 1 < lanes[text], first, states)
    end, tokens = scan(maps, within + 1 < lanes[text])
    entry = np.searchsorted(maps[0], first << 32 | states)
    return tokens[entry], machine.keys[int(end[entry[-1]])]


def _codes(texts: list[str]) -> np.ndarray:
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    codes[codes == 0x20] = SPACE_CODE
    return codes


def count(machine: Transducer, texts: list[str]) -> list[int]:
    """Tokens of each text, in slabs of bounded size."""
    out = [0] * len(texts)
    some, of, size, carried = [], [], 0, None

    def flush(last: tuple | None) -> tuple:
        if len(machine.keys) > MOST_STATES:
            machine.forget()
        tokens, key = count_slab(machine, _codes(some), list(map(len, some)), last)
        for i, n in zip(of, tokens.tolist(), strict=True):
            out[i] += n
        some.clear()
        of.clear()
        return key

    for i, text in enumerate(texts):
        if not text:
            continue
        at, text = 0, SPACE + text
        while at < len(text):
            part = text[at : at + SLAB - size]
            some.append(part)
            of.append(i)
            at, size = at + len(part), size + len(part)
            if size >= SLAB:
                key, size = flush(carried), 0
                carried = key if at < len(text) else None
    if some:
        flush(carried)
    return out


_MACHINES: dict[str, Transducer] = {}


def _count(path: str):
    def run(batches):
        exclusive("token_count", _MACHINES)
        if path not in _MACHINES:
            _MACHINES[path] = Transducer(path)
        for batch in batches:
            text = batch.column(1)
            tokens = count(_MACHINES[path], text.to_pylist())
            n_bytes = pc.cast(pc.fill_null(pc.binary_length(text), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of docs (doc_id, text); model: place of a sentencepiece model of byte pairs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, _count(model), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
