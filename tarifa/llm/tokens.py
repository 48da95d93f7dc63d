"""Token counts by a finite-state transducer compiled from a byte-fallback BPE model of sentencepiece.

The tokens of a prefix decide those of the prefix with one more character: its last token is the one piece that ends
there and doesn't merge with the token before it. So a deterministic transducer reads a text character by
character: a state holds the pieces that may still grow and the last tokens where they begin, a transition
carries how many tokens the text has gained or lost. States are made when a text first needs them and live in numpy tables.

A state is forgotten where a space follows anything else, and after a character that no piece holds. Texts are laid end to end and cut
into chunks, whose state maps are found in lock step: that of a chunk with such a place is constant; that of any other is known for one
state that may enter it, the one to which the characters before the chunk lead. A parallel prefix scan composes the maps pairwise,
in as many rounds as the number of chunks has binary digits. Where a composed map meets a state that the next one isn't known for, that
one runs again, up to where it meets its earlier course, and the scan is repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tarifa.llm.shared import REMEMBERED, blocks, forget, utf8

SPACE = "▁"
#: Characters with a column of their own in the tables; others take the slow way.
COLUMNS = 128
#: States after which a worker starts over with empty tables.
MOST_STATES = 300_000
CHUNK, BLOCK_BYTES = 512, 2 << 20
#: Characters before a chunk that lead to the state that may enter it.
WARM = 32
#: Rounds after which maps are found for all states that are likely to enter, and how many those may be.
ROUNDS, MOST_KNOWN = 4, 64


def _scan(enter: np.ndarray, leave: np.ndarray, constant: np.ndarray) -> np.ndarray:
    """The state after each chunk, from composing the chunks' maps pairwise; -1 where a map isn't known for the state that enters it.

    A chunk's map sends `enter` to `leave`, and every state if it is constant. The first chunk's is taken as constant.
    """
    leave, constant, step = leave.copy(), constant.copy(), 1
    constant[:1] = True
    while step < len(leave):
        met = constant[step:] | (leave[:-step] == enter[step:])
        meets = np.where(constant[step:], leave[step:], np.where(met, leave[step:], -1))
        first, whole = enter.copy(), constant.copy()
        first[step:] = enter[:-step]
        whole[step:] |= constant[:-step]
        leave, enter, constant, step = np.concatenate([leave[:step], meets]), first, whole, 2 * step
    return leave


class Transducer:
    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = range(model.get_piece_size())
        plain = [i for i in size if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.growing = {p[:n] for p in self.scores for n in range(1, len(p))}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.columns = np.full(0x110000, -1, np.int16)
        self.known = np.zeros(0x110000, bool)
        for p in self.scores:
            if len(p) == 1:
                self.known[ord(p)] = True
        self.alphabet: list[str] = []
        self.clear()

    def clear(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.slow: dict[tuple[int, str], tuple[int, int]] = {}
        self.next = np.full((1024, COLUMNS), -1, np.int32)
        self.gain = np.zeros((1024, COLUMNS), np.int8)
        self.fresh = self.number(("", ("",), (0,)))

    def number(self, state: tuple) -> int:
        found = self.ids.get(state)
        if found is None:
            found = self.ids[state] = len(self.states)
            self.states.append(state)
            if found >= len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.gain = np.concatenate([self.gain, np.zeros_like(self.gain)])
        return found

    def apart(self, left: str, right: str) -> bool:
        """Whether the two pieces stay two when the model tokenizes them together."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            found = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return found

    def merged(self, text: str) -> list[str]:
        """Tokens of a short text by repeated merging: best score first, leftmost on ties."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def step(self, state: int, char: str) -> tuple[int, int]:
        """The state after char, and the tokens gained."""
        grown, lasts, counts = self.states[state]
        if char == SPACE and not grown.endswith(SPACE) and state != self.fresh:
            return self.step(self.fresh, char)
        if not self.known[ord(char)]:
            return self.fresh, len(char.encode())
        text, now = grown + char, counts[-1]
        for n in range(len(text)):  # the longest piece first
            piece, before = text[n:], lasts[n]
            if (n == 0 or text[n:-1] in self.growing or len(piece) == 1) and (len(piece) == 1 or piece in self.scores) and (not before or self.apart(before, piece)):
                break
        count = counts[n] + 1
        lasts, counts = (*lasts, piece), (*counts, count)
        n = 0
        while n < len(text) and text[n:] not in self.growing:
            n += 1
        kept = [text[i:] in self.growing for i in range(n, len(text))]  # nothing grows from the other places
        lasts = (*(t if k else "" for t, k in zip(lasts[n:], kept)), lasts[-1])
        counts = (*(c - count if k else 0 for c, k in zip(counts[n:], kept)), 0)
        return self.number((text[n:], lasts, counts)), count - now

    def moves(self, states: np.ndarray, chars: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of every lane."""
        after = self.next[states, columns]
        gains = self.gain[states, columns]
        missing = np.flatnonzero((after < 0) | (columns < 0))
        if missing.size:
            keys, back = np.unique(states[missing].astype(np.int64) << 21 | chars[missing], return_inverse=True)
            made = np.empty((len(keys), 2), np.int64)
            for i, key in enumerate(keys.tolist()):
                state, char = key >> 21, chr(key & 0x1FFFFF)
                column = int(self.columns[ord(char)])
                if column < 0:
                    made[i] = self.slow[state, char] if (state, char) in self.slow else self.slow.setdefault((state, char), self.step(state, char))
                else:
                    made[i] = self.step(state, char)
                    self.next[state, column], self.gain[state, column] = made[i]
            after[missing], gains[missing] = made[back, 0], made[back, 1]
        return after, gains

    def gains(self, chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Tokens gained at each character of texts laid end to end; starts: where each text begins."""
        if len(self.states) > MOST_STATES or len(self.slow) > MOST_STATES:
            self.clear()
        total = len(chars)
        new = np.unique(chars[self.columns[chars] < 0])
        for char in new.tolist():
            if len(self.alphabet) < COLUMNS:
                self.columns[char] = len(self.alphabet)
                self.alphabet.append(chr(char))
        columns = self.columns[chars]
        space = chars == ord(SPACE)
        reset = np.zeros(total, bool)
        reset[1:] = (space[1:] & ~space[:-1]) | ~self.known[chars[:-1]]
        reset[starts] = True
        gained = np.zeros(total, np.int8)
        begins = np.arange(0, total, CHUNK)
        ends = np.minimum(begins + CHUNK, total)
        places = np.flatnonzero(reset)
        first = np.append(places, total)[np.searchsorted(places, begins)]
        course = np.full(total, -1, np.int32)  # the state after each character, as last run

        def run(at: np.ndarray, stop: np.ndarray, states: np.ndarray, again: bool = False) -> None:
            """Lanes in lock step; when run `again`, a lane ends where it meets its earlier course."""
            order = np.argsort(at - stop, kind="stable")  # the longest first: lanes end from the back
            at, states, left = at[order], states[order], (stop - at)[order]
            for j in range(int(left[0]) if len(left) else 0):
                alive = int(np.searchsorted(-left, -j, "left"))
                if not alive:
                    break
                here = at[:alive] + j
                now = np.where(reset[here], self.fresh, states[:alive])
                states[:alive], gained[here] = self.moves(now, chars[here], columns[here])
                if again:
                    going = np.flatnonzero(course[here] != states[:alive])
                    course[here] = states[:alive]
                    if len(going) < alive:
                        at, states, left = at[going], states[going], left[going]
                else:
                    course[here] = states[:alive]

        constant = first < ends
        run(first[constant], ends[constant], np.full(int(constant.sum()), self.fresh, np.int64))
        heads = np.where(constant, first, ends)  # up to here a chunk depends on what enters it
        enter = np.full(len(begins), self.fresh, np.int64)
        unsure = np.flatnonzero(heads > begins)
        before = ends[unsure - 1] - 1  # chunk 0 begins with a text, so it isn't unsure
        exact = course[before] >= 0
        enter[unsure[exact]] = course[before[exact]]
        guess = unsure[~exact]
        lead = np.full(len(guess), self.fresh, np.int64)
        for j in range(-WARM, 0):
            here = np.maximum(begins[guess] + j, 0)
            lead, _ = self.moves(np.where(reset[here], self.fresh, lead), chars[here], columns[here])
        enter[guess] = lead
        run(begins[unsure], heads[unsure], enter[unsure])
        rounds = 0
        while True:
            leave = course[ends - 1].astype(np.int64)
            reached = _scan(enter, leave, constant)[unsure - 1]
            entering = np.where(reached >= 0, reached, leave[unsure - 1])  # beyond an unknown one: what is likely to enter
            wrong = np.flatnonzero(entering != enter[unsure])
            if not len(wrong):
                return gained
            rounds += 1
            if rounds % ROUNDS == 0:  # a text that never falls into step, as one of few characters
                entering = self.entering(chars, columns, begins, ends, leave, constant)[unsure]
                wrong = np.flatnonzero(entering != enter[unsure])
            enter[unsure[wrong]] = entering[wrong]
            run(begins[unsure[wrong]], heads[unsure[wrong]], entering[wrong], again=True)

    def entering(self, chars: np.ndarray, columns: np.ndarray, begins: np.ndarray, ends: np.ndarray, leave: np.ndarray, constant: np.ndarray) -> np.ndarray:
        """The state that enters each chunk, from maps that are known for all states seen at chunks' ends, as long as those are few."""
        known = np.unique(leave)
        open_ = np.flatnonzero(~constant)
        while True:
            maps = np.repeat(np.searchsorted(known, leave)[:, None], len(known), 1)  # of places in `known`
            states = np.tile(known, len(open_))
            at = np.repeat(begins[open_], len(known))
            for j in range(CHUNK):
                here = at + j
                live = here < np.repeat(ends[open_], len(known))
                moved, _ = self.moves(states, chars[np.minimum(here, len(chars) - 1)], columns[np.minimum(here, len(chars) - 1)])
                states = np.where(live, moved, states)
            more = np.union1d(known, states)
            if len(more) == len(known) or len(more) > MOST_KNOWN:
                break
            known = more
        states = states.reshape(-1, len(known))
        place = np.searchsorted(known, states)
        met = known[np.minimum(place, len(known) - 1)] == states
        maps[open_] = np.where(met, place, -1)
        step = 1
        while step < len(maps):  # map n becomes map n after map n - step
            before, after = maps[:-step], maps[step:]
            made = np.where(before >= 0, np.take_along_axis(after, np.maximum(before, 0), 1), -1)
            made[constant[step:]] = after[constant[step:]]
            maps = np.concatenate([maps[:step], made])
            step *= 2
        found = maps[:-1, 0]  # the first chunk begins with a text: all states lead to one
        return np.concatenate([[self.fresh], np.where(found >= 0, known[np.maximum(found, 0)], leave[:-1])])

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        filled = [i for i, t in enumerate(texts) if t]
        if filled:
            laid = [SPACE + texts[i] for i in filled]
            chars = np.frombuffer("".join(laid).encode("utf-32-le"), np.uint32).astype(np.int64)
            chars[chars == 32] = ord(SPACE)
            starts = np.cumsum([0, *map(len, laid[:-1])])
            out[filled] = np.add.reduceat(self.gains(chars, starts), starts, dtype=np.int64)
        return out


_MADE: dict[str, Transducer] = REMEMBERED.setdefault("tokens", {})


def transducer(model_file: str) -> Transducer:
    if model_file not in _MADE:
        _MADE[model_file] = Transducer(model_file)
    return _MADE[model_file]


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs (doc_id, text); nothing is shuffled.

    model_file is a byte-fallback BPE model of sentencepiece on every executor. Null and empty texts have no bytes and no tokens.
    Repeated rows are counted alike; a null doc_id stays null; an empty table gives an empty result; extra columns are not
    read. A text of any length takes as much memory as a few times its own size.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget("tokens")
        machine = transducer(model_file)
        for batch in batches:
            column = pc.fill_null(batch.column("text"), "")
            offsets, _ = utf8(column)
            sizes = np.diff(offsets)
            tokens = [machine.counts(column.slice(a, b - a).to_pylist()) for a, b in blocks(offsets, BLOCK_BYTES)]
            tokens = np.concatenate([np.zeros(0, np.int64), *tokens])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(counted, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
