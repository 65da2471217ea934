"""Token counts by a finite-state transducer compiled from the tokenizer's own vocabulary.

BPE over a run of symbols has a last token for every prefix, and a token may follow another exactly if BPE leaves
the two apart when it gets both. So the tokens of a run can be found from left to right: what matters of the past is,
for each suffix that some token may still extend, the last token before it and how many tokens there were. That is a
finite state. Each transition carries the number of tokens it adds (it may be negative: a longer token can swallow
several). States are compiled when a text first needs them, and then serve all later texts of the worker.

Texts of a batch lie behind one another and are cut into chunks of equal size which all advance together, a byte at a
time. White space leads every state to the start state, so a chunk that holds some ends in one state whatever it begins
with. Any other chunk has a map from the states it may begin with to those it ends in: the start state, and what the
chunks before it can hand on. The maps of all chunks are composed by a parallel prefix scan, which gives each chunk's
first state; maps that lack a state which the scan needs are widened, and the scan runs again. Paths from different
states soon meet, so two or three rounds do for a run of any length.

White space splits words from each other in this tokenizer, whatever they hold. Words with other characters than ASCII
and the Latin letters U+00C0 to U+00FF are normalised and split by the library's rules first; then each piece goes
through the transducer behind a mark that makes it one run, so every script is compiled. Words with `<|`, which may
hold a special token, are counted by the library. When `MAX_STATES` are compiled, words that need others are
counted by the library too; where these are more than `MISSED` of a block's bytes, the next block starts with no states.

null and empty texts have 0 tokens.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import batched, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfloom.llm.tables import slices, small_batches

#: States a worker keeps at most, which bounds its memory.
MAX_STATES = 131_072
#: With more than this share of a block's bytes beyond the compiled states, these serve other texts than those at hand.
MISSED = 0.1
CHUNK = 512
#: Bytes of text that advance together.
BLOCK = 4 << 20
#: Up to so many states the maps of chunks without white space are widened all together.
MAP_STATES = 8
LIMIT = 2048
#: A byte that no text holds: what follows it up to white space is one run.
RUN = 0xFF
#: Words of other scripts that are split together.
WORDS = 10_000

# Fixed values of the tokenizer's pattern.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

_SPACE, _DIGIT, _LETTER, _OTHER = range(4)


def _byte_symbols() -> list[str]:
    """The character that byte-level vocabularies write for each byte."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class Transducer:
    """The deterministic transducer of one BPE vocabulary with word ends."""

    START = 0

    def __init__(self, path: str, max_states: int = MAX_STATES):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.end = model["end_of_word_suffix"]
        self.symbols = _byte_symbols()
        self.bytes_of = {ord(c): b for b, c in enumerate(self.symbols)}
        merges = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.rank = {m: i for i, m in enumerate(merges)}
        self.vocab = set(model["vocab"])
        self.prefixes = {t[:i] for t in self.vocab for i in range(1, len(t.removesuffix(self.end)))}
        self.max_states = max_states
        self.apart: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        # Columns: 0 white space, then the bytes that occur in words.
        self.column = np.zeros(256, np.uint8)
        used = [b for b in (*range(33, 127), *range(128, 192), *range(0xC2, 0xF5), RUN) if not 65 <= b <= 90] + [b for b in range(33) if b not in (9, 10, 11, 12, 13, 32)] + [127]
        for k, b in enumerate(used):
            self.column[b] = k + 1
        self.used = used
        self.kind = np.full(256, _OTHER, np.uint8)
        self.kind[[9, 10, 11, 12, 13, 32]] = _SPACE
        self.kind[48:58] = _DIGIT
        self.kind[97:123] = self.kind[65:91] = self.kind[128:] = _LETTER
        self.digit = {b: self._finish(self._grow((("", None, 0),), self.symbols[b])) for b in range(48, 58)}
        self.quoted = {c: len(self._bpe(self._split(c))) for c in CONTRACTIONS}
        self._forget()

    def _forget(self) -> None:
        """Drops all compiled states but the first, and what was learnt of tokens on the way."""
        self.missed = 0.0
        self.apart.clear()
        self.whole.clear()
        self.ids: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.to = np.full((1024, len(self.used) + 1), -1, np.int32)
        self.adds = np.zeros((1024, len(self.used) + 1), np.int16)
        self._state(("start",))

    # BPE by its definition, for short strings.
    def _split(self, text: str) -> list[str]:
        out = [self.symbols[b] for b in text.encode()]
        out[-1] += self.end
        return out

    def _bpe(self, parts: list[str]) -> list[str]:
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 30))
            a, b = parts[best], parts[best + 1]
            if (a, b) not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _symbols_of(self, token: str) -> list[str]:
        if token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _is_whole(self, token: str) -> bool:
        if (known := self.whole.get(token)) is None:
            known = self.whole[token] = self._bpe(self._symbols_of(token)) == [token]
        return known

    def _are_apart(self, a: str, b: str) -> bool:
        if (known := self.apart.get((a, b))) is None:
            known = self.apart[a, b] = self._bpe(self._symbols_of(a) + self._symbols_of(b)) == [a, b]
        return known

    def _last(self, live: tuple, symbol: str) -> tuple[str, int]:
        """The last token when `symbol` is appended, and the tokens up to it, relative to those before."""
        for suffix, last, count in live:
            token = suffix + symbol
            if token in self.vocab and self._is_whole(token) and (last is None or self._are_apart(last, token)):
                return token, count + 1
        raise ValueError(f"the vocabulary has no token for {symbol!r}")

    def _grow(self, live: tuple, symbol: str) -> tuple:
        """The state's history after one more symbol, what the run has if it ends here, and the change in tokens."""
        token, change = self._last(live, symbol)
        ended = self._last(live, symbol + self.end)[1] - change
        kept = [(s + symbol, last, c - change) for s, last, c in live if s + symbol in self.prefixes]
        return (*kept, ("", token, 0)), ended, change

    def _finish(self, grown: tuple) -> int:
        return grown[1] + grown[2]

    def _state(self, key: tuple) -> int:
        if (i := self.ids.get(key)) is None:
            if len(self.keys) >= self.max_states:
                return -2
            i = self.ids[key] = len(self.keys)
            self.keys.append(key)
            if i == len(self.to):
                self.to = np.concatenate([self.to, np.full_like(self.to, -1)])
                self.adds = np.concatenate([self.adds, np.zeros_like(self.adds)])
            left = key[2] if key[0] in "lpr" else 0
            if key[0] == "'":
                left = self._run("p", "'")[1]
            if key[0] == "'x":
                left = self._run("p", "'")[1] + self._run("l", key[1])[1]
            self.to[i, 0], self.adds[i, 0] = self.START, left
        return i

    def _run(self, kind: str, text: str) -> tuple[tuple, int, int]:
        """The key after a run of `text`, its tokens if it ends here, and those counted so far."""
        live, total, ended = (("", None, 0),), 0, 0
        for ch in text.encode():
            live, ended, change = self._grow(live, self.symbols[ch])
            total += change
        return (kind, live, ended), total + ended, total

    def _fresh(self, b: int) -> tuple[tuple, int]:
        kind = self.kind[b]
        if b == RUN:
            return ("r", (("", None, 0),), 0), 0
        if kind == _DIGIT:
            return ("start",), self.digit[b]
        if b == 39:
            return ("'",), 0
        live, ended, change = self._grow((("", None, 0),), self.symbols[b])
        return ("l" if kind == _LETTER else "p", live, ended), change

    def _next(self, key: tuple, b: int) -> tuple[tuple, int]:
        kind = self.kind[b]
        if key[0] == "start":
            return self._fresh(b)
        if key[0] in "lpr":
            if key[0] == "r" or (key[0] == "l") == (kind == _LETTER) and kind != _DIGIT:
                live, ended, change = self._grow(key[1], self.symbols[b])
                return (key[0], live, ended), change
            k, n = self._fresh(b)
            return k, n + key[2]
        quote, _, begun = self._run("p", "'")
        alone = begun + quote[2]
        if key[0] == "'":
            if "'" + chr(b) in self.quoted:
                return ("start",), self.quoted["'" + chr(b)]
            if chr(b) in "rvl":
                return ("'x", chr(b)), 0
            if kind == _OTHER:
                k, n = self._next(quote, b)
                return k, n + begun
            k, n = self._fresh(b)
            return k, n + alone
        if f"'{key[1]}{chr(b)}" in self.quoted:
            return ("start",), self.quoted[f"'{key[1]}{chr(b)}"]
        letter, _, counted = self._run("l", key[1])
        k, n = self._next(letter, b)
        return k, n + alone + counted

    def _compile(self, states: np.ndarray, columns: np.ndarray) -> None:
        for code in np.unique(states.astype(np.int64) * 256 + columns):
            s, c = int(code) >> 8, int(code) & 255
            key, n = self._next(self.keys[s], self.used[c - 1])
            i = self._state(key)
            self.to[s, c], self.adds[s, c] = i, n

    def _block(self, text: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Tokens by owner of the bytes `text`, in which every owner's text ends with a space."""
        if self.missed > MISSED:
            self._forget()
        out = np.zeros(n, np.int64)
        pad = -len(text) % CHUNK
        grid = np.concatenate([self.column[text], np.zeros(pad, np.uint8)]).reshape(-1, CHUNK)
        # Tokens belong to owners, so the counts are taken up to every owner's end: by walking with running totals.
        space = grid == 0
        has = space.any(1)
        first = np.where(has, space.argmax(1), CHUNK)
        tail = np.arange(CHUNK)[None, :] > first[:, None]
        running = np.zeros(grid.shape, np.int16)
        bad = np.zeros(grid.shape, bool)
        exits = self._walk(grid, tail, np.zeros(len(grid), np.int32), running, bad)
        previous = self._first_states(grid, has, exits)
        # White space at a chunk's first byte still carries the last tokens of the word before.
        self._walk(grid, ~tail, previous, running, bad)
        flat = running.reshape(-1)[: len(text)]
        sums = np.bincount(owner, weights=flat, minlength=n)
        out += sums.astype(np.int64)
        if bad.any():
            out += self._beyond(text, owner, n, flat, bad.reshape(-1)[: len(text)])
        return out

    def _first_states(self, grid: np.ndarray, has: np.ndarray, exits: np.ndarray) -> np.ndarray:
        """The state that each chunk begins with; `exits` are the last states of chunks that have white space."""
        n, last = len(grid), len(grid) - 1
        if has.all():
            return np.concatenate([[self.START], exits[:-1]]).astype(np.int32)
        # Maps: states that a chunk may begin with, and those that it then ends in. -1 stands for none.
        enter = np.full((n, 1), self.START, np.int32)
        leave = np.where(has, exits, -1).astype(np.int32)[:, None]
        plain = ~has
        while True:
            rows, columns = np.nonzero((leave == -1) & (enter != -1) & plain[:, None])
            if len(rows):
                leave[rows, columns] = self._walk(grid[rows], np.ones((len(rows), CHUNK), bool), enter[rows, columns], np.zeros((len(rows), CHUNK), np.int16), np.zeros((len(rows), CHUNK), bool))
            # As places in the successor's map; `wide` stands for a state that the map lacks.
            wide = enter.shape[1]
            to = np.full((n, wide + 1), wide, np.int64)
            for k in range(wide):
                same = (leave[:last, k, None] == enter[1:]) & (leave[:last, k, None] != -1)
                to[:last, k] = np.where(same.any(1), same.argmax(1), wide)
            to[has] = to[has, :1]
            # The scan: row i maps the places of the first chunk's states to those of the chunk behind i.
            through = to.copy()
            reach = 1
            while reach < n:
                later = np.take_along_axis(through[reach:], through[:-reach], 1)
                through = np.concatenate([through[:reach], later])
                reach *= 2
            place = np.concatenate([[0], through[:last, 0]])
            known = place < wide
            # A chunk with white space ends in its state wherever it begins.
            needed = plain & ~known
            if not needed.any():
                return np.concatenate([[self.START], leave[np.arange(last), np.where(plain, place, 0)[:last]]]).astype(np.int32)
            if wide >= MAP_STATES:
                # So many states are rare. From here on a map takes up only what the scan has found to come.
                for i in np.flatnonzero(needed).tolist():
                    if known[i - 1] or has[i - 1]:
                        enter[i, -1], leave[i, -1] = leave[i - 1, place[i - 1] if plain[i - 1] else 0], -1
                continue
            more = {i: sorted({int(x) for x in leave[i - 1] if x != -1} - {int(x) for x in enter[i]}) for i in (np.flatnonzero(plain[1:]) + 1).tolist()}
            grow = max(map(len, more.values()))
            enter, leave = (np.concatenate([x, np.full((n, grow), -1, np.int32)], axis=1) for x in (enter, leave))
            for i, states in more.items():
                enter[i, wide : wide + len(states)] = states

    def _walk(self, grid: np.ndarray, on: np.ndarray, state: np.ndarray, adds: np.ndarray, bad: np.ndarray) -> np.ndarray:
        """Writes what each byte where `on` adds to `adds`, and True to `bad` where a state beyond the limit is left."""
        columns, active = np.ascontiguousarray(grid.T), np.ascontiguousarray(on.T)
        for k in range(grid.shape[1]):
            a = active[k]
            if not a.any():
                continue
            c = columns[k]
            to = self.to[state, c]
            if (new := (to == -1) & a).any():
                self._compile(state[new], c[new])
                to = self.to[state, c]
            adds[:, k] = np.where(a, self.adds[state, c], adds[:, k])
            gone = (to == -2) & a
            if gone.any():
                bad[:, k] |= gone
                to = np.where(gone, self.START, to)
            state = np.where(a, to, state)
        return state

    def _beyond(self, text: np.ndarray, owner: np.ndarray, n: int, adds: np.ndarray, bad: np.ndarray) -> np.ndarray:
        """The correction for words that left the compiled states: they are counted by the library instead."""
        space = self.kind[text] == _SPACE
        word = np.cumsum(space)
        out = np.zeros(n, np.int64)
        starts = np.flatnonzero(space)
        texts, owners, size = [], [], 0
        for w in np.unique(word[bad]):
            a, b = (starts[w - 1] + 1 if w else 0), (starts[w] if w < len(starts) else len(text))
            size += int(b - a)
            # The space behind the word carries its last tokens.
            out[owner[a]] -= int(adds[a : b + 1].sum())
            if text[a] == RUN:
                out[owner[a]] += len(self.library.model.tokenize("".join(self.symbols[x] for x in text[a + 1 : b].tolist())))
                continue
            texts.append(text[a:b].tobytes().decode())
            owners.append(owner[a])
        self.missed = size / len(text)
        np.add.at(out, np.array(owners, np.int64), self._by_library(texts))
        return out

    def _by_library(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """The tokens of each text. Long texts are counted in parts that end at white space."""
        out = np.zeros(len(texts), np.int64)
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) < BLOCK):
                size += len(texts[j]) + 1
                j += 1
            out[i:j] = self._some(texts[i:j]) if j > i + 1 or len(texts[i]) <= BLOCK else sum(self._some([p])[0] for p in _parts(texts[i]))
            i = j
        return out

    def _some(self, texts: list[bytes]) -> np.ndarray:
        n = len(texts)
        text = np.frombuffer(b" ".join(texts) + b" ", np.uint8).copy()
        lengths = np.fromiter(map(len, texts), np.int64, n) + 1
        owner = np.repeat(np.arange(n, dtype=np.int32), lengths)
        upper = (text >= 65) & (text <= 90)
        text[upper] += 32
        none = np.zeros(1, np.uint8)
        after, before = np.concatenate([none, text[:-1]]), np.concatenate([text[1:], none])
        lead = text == 0xC3
        capital = (after == 0xC3) & (text >= 0x80) & (text <= 0x9E) & (text != 0x97)
        latin = (after == 0xC3) & (text >= 0x80) & (text != 0x97) & (text != 0xB7)
        strange = (text >= 0x80) & ~lead & ~latin | lead & ((before == 0x97) | (before == 0xB7)) | (text == 60) & (before == 124)
        text[capital] += 32
        out = np.zeros(n, np.int64)
        if strange.any():
            space = self.kind[text] == _SPACE
            word = np.cumsum(space)
            hit = np.unique(word[strange])
            ends = np.flatnonzero(space)
            a = np.where(hit > 0, ends[hit - 1] + 1, 0)
            b = ends[hit]
            raw = b" ".join(texts) + b" "
            found = [raw[x:y].decode("utf-8", "replace") for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            special = np.array(["<|" in w for w in found])
            np.add.at(out, owner[a[special]], self._by_library([w for w in found if "<|" in w]))
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                text[x:y] = 32
            runs, owners = [], []
            for o, group in groupby(zip(owner[a].tolist(), found, strict=True), lambda x: x[0]):
                for words in batched((w for _, w in group if "<|" not in w), WORDS):
                    runs.append(self._pieces(" ".join(words)))
                    owners.append(o)
            if runs:
                whole = np.frombuffer(b"".join(runs), np.uint8)
                out += self._block(whole, np.repeat(np.array(owners, np.int32), [len(r) for r in runs]), n)
        return out + self._block(text, owner, n)

    def _pieces(self, words: str) -> bytes:
        """The pieces that the library splits `words` into, each between a mark and a space."""
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(words))
        return "".join(f"{chr(RUN)}{p} " for p, _ in pieces).translate(self.bytes_of).encode("latin-1")


_WHITE = re.compile(rb"[\t-\r ]")


def _parts(text: bytes) -> Iterator[bytes]:
    """The text in parts of about BLOCK bytes that begin behind white space."""
    at = 0
    while at < len(text):
        m = _WHITE.search(text, at + BLOCK)
        end = m.end() if m else len(text)
        yield text[at:end]
        at = end


_compiled: dict[tuple[str, int], Transducer] = {}


def transducer(path: str, max_states: int = MAX_STATES) -> Transducer:
    """One for each worker process; what it has compiled serves all later batches."""
    if (path, max_states) not in _compiled:
        _compiled[path, max_states] = Transducer(path, max_states)
    return _compiled[path, max_states]


def count_tokens(docs: DataFrame, file: str = "word_bpe_49k.json", max_states: int = MAX_STATES) -> DataFrame:
    """doc_id, n_bytes, n_tokens for every row of `docs` (doc_id, text); rows are not shuffled.

    null or empty text: 0 bytes, 0 tokens. A null doc_id or repeated rows are counted like others. Other columns are ignored.
    """

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        t = transducer(public_tokenizers.path(file), max_states)
        for batch, texts in slices(batches, 1, BLOCK):
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(t.counts(texts))], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
