"""Token counts from a compiled finite-state tokenizer.

Two deterministic transducers are compiled from a byte-level BPE tokenizer file.

*Splitter.* Over character classes (letter, number, white space, blank, other, the
letters of contractions) it finds where pre-tokens begin. A text is cut into chunks of
equal length; every chunk's map (entry state -> exit state) is composed with those
before it by a parallel prefix scan in numpy, which gives the entry state of every
chunk; the transitions out of it mark the boundaries.

*Counter.* Over the bytes of a pre-token. The encoding of a prefix is the encoding of
a shorter prefix plus one token, so a state holds what later bytes can ask about: for
every position of the last bytes from where some token may still go on, the last token and
the count relative to now. A transition is annotated with the tokens it emits (the
change of the count, which may be negative when tokens join). States are determinised
on first use and shared by all texts of a worker; at a limit, also inside a text, the table
starts anew from the current state, so that it stays bounded however long a text is.

Defined results: null texts count as empty (0 bytes, 0 tokens); the file's added
tokens inside a text count one each, as the library does by default; texts of any
length are counted whole, also those without any blank. Rows that repeat are rows of their
own; an empty table gives no rows. Other columns are carried along, but for those with the
names of results.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.common import carried, table

LIMIT = 512
#: CHUNK: characters of a chunk whose state maps compose. STATES, WORDS: most states and whole pre-tokens that a task remembers.
CHUNK, STATES, WORDS, WORD_CHARS = 64, 100_000, 500_000, 32

# Character classes. The contraction letters s d m t v r l e are kept apart from the other letters;
# CONTRACTS is a quote before one of 's 'd 'm 't 've 're 'll.
OTHER, LETTER, NUMBER, SPACE, BLANK, QUOTE = range(6)
_TAIL = {"s": 6, "d": 7, "m": 8, "t": 9, "v": 10, "e": 11, "r": 12, "l": 13}
CONTRACTS, CLASSES = 14, 15


def character_classes() -> np.ndarray:
    """Class of every code point."""
    import regex

    points = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    classes = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        classes[[ord(c) for c in regex.findall(pattern, points)]] = kind
    classes[ord(" ")], classes[ord("'")] = BLANK, QUOTE
    for c, kind in _TAIL.items():
        classes[ord(c)] = kind
    return classes


class Splitter:
    """The pre-tokens 's 't 're 've 'm 'll 'd | ?letters | ?numbers | ?others | white space, as an automaton.

    White space before a word gives its last blank to the word, which needs one character of lookahead:
    the automaton reads class pairs (this character, the next one). A transition says whether a pre-token
    begins at its character. The state maps that strings of class pairs can cause are few; they are
    numbered when the automaton is compiled, and composing two of them is one look-up.
    """

    # states: what the pre-token that holds the last character may still take
    START, LETTERS, NUMBERS, OTHERS, WHITE, OPEN, QUOTED, Q2, DONE = range(9)
    N = 9

    def __init__(self) -> None:
        self.classes = character_classes()
        pairs = [(c, ahead) for c in range(CLASSES) for ahead in range(CLASSES + 1)]
        steps = [[self._step(state, c, ahead) for state in range(self.N)] for c, ahead in pairs]
        self.next = np.array([x[0] for row in steps for x in row], np.uint8)
        self.begin = np.array([x[1] for row in steps for x in row], bool)
        number: dict[tuple[int, ...], int] = {tuple(range(self.N)): 0}
        letters = list(dict.fromkeys(tuple(x[0] for x in row) for row in steps))
        todo = list(number)
        while todo:
            first = todo.pop()
            for then in letters:
                both = tuple(then[x] for x in first)
                if both not in number:
                    number[both] = len(number)
                    todo.append(both)
        self.maps = np.array(list(number), np.uint8)
        self.product = np.array([[number[tuple(b[x] for x in a)] for b in number] for a in number], np.uint16)
        self.map_of = np.array([number[tuple(x[0] for x in row)] for row in steps], np.uint16)

    @classmethod
    def _step(cls, state: int, c: int, ahead: int) -> tuple[int, bool]:
        letter, white, other = c == LETTER or QUOTE < c < CONTRACTS, c in (SPACE, BLANK), c in (OTHER, QUOTE, CONTRACTS)
        word_ahead = ahead not in (SPACE, BLANK, CLASSES)
        kind = cls.LETTERS if letter else cls.NUMBERS if c == NUMBER else cls.OTHERS
        if state == cls.QUOTED:  # behind a quote that begins a contraction: its next letter is certain
            return (cls.Q2 if c in (_TAIL["v"], _TAIL["r"], _TAIL["l"]) else cls.DONE), False
        if state == cls.Q2:
            return cls.DONE, False
        if state == cls.LETTERS and letter or state == cls.NUMBERS and c == NUMBER or state == cls.OTHERS and other:
            return state, False
        if state == cls.OPEN and not white:  # a blank before a word
            return kind, False
        if white:
            if word_ahead:  # the last of a white run: a blank opens the next pre-token, another character stands alone
                return (cls.OPEN if c == BLANK else cls.DONE), True
            return cls.WHITE, state != cls.WHITE
        return (cls.QUOTED if c == CONTRACTS else kind), True

    def starts(self, text: str) -> np.ndarray:
        """Offsets at which pre-tokens begin."""
        kinds = self.classes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        if "'" in text:
            self._mark_contractions(kinds)
        n = len(kinds)
        pair = kinds.astype(np.int32) * (CLASSES + 1)
        pair[:-1] += kinds[1:]
        pair[-1] += CLASSES
        maps = np.zeros(-(-n // CHUNK) * CHUNK, np.uint16)  # number 0 leaves every state as it is
        maps[:n] = self.map_of[pair]
        now = self.scan(self.compose(maps.reshape(-1, CHUNK)))
        base = np.zeros(len(maps), np.int32)
        base[:n] = pair * self.N
        base = np.ascontiguousarray(base.reshape(-1, CHUNK).T)
        for k in range(CHUNK):
            base[k] += now
            now = self.next[base[k]]
        return np.flatnonzero(self.begin[np.ascontiguousarray(base.T).reshape(-1)[:n]])

    @staticmethod
    def _mark_contractions(kinds: np.ndarray) -> None:
        at = np.flatnonzero(kinds == QUOTE)
        one, two = (np.where(at + k < len(kinds), kinds[np.minimum(at + k, len(kinds) - 1)], OTHER) for k in (1, 2))
        short = np.isin(one, [_TAIL[x] for x in "sdmt"])
        long = (two == _TAIL["e"]) & np.isin(one, [_TAIL["v"], _TAIL["r"]]) | (two == _TAIL["l"]) & (one == _TAIL["l"])
        kinds[at[short | long]] = CONTRACTS

    def compose(self, maps: np.ndarray) -> np.ndarray:
        """Map of every chunk: halves are composed until one map is left."""
        while maps.shape[1] > 1:
            maps = self.product[maps[:, 0::2], maps[:, 1::2]]
        return maps[:, 0]

    def scan(self, maps: np.ndarray) -> np.ndarray:
        """Entry state of every chunk: a prefix scan of the maps by doubling, shifted by one."""
        maps, step = maps.copy(), 1
        while step < len(maps):
            maps[step:] = self.product[maps[:-step], maps[step:]]
            step *= 2
        return np.concatenate([[self.START], self.maps[maps[:-1], self.START]]).astype(np.uint8)


class Counter:
    """Byte transducer whose transitions carry the number of tokens they emit."""

    def __init__(self, pairs: dict[tuple[bytes, bytes], int]) -> None:
        self.rank = pairs
        self.parts: dict[bytes, tuple[bytes, bytes] | None] = {bytes([b]): None for b in range(256)}
        for (a, b), _ in sorted(pairs.items(), key=lambda x: x[1]):
            self.parts.setdefault(a + b, (a, b))
        # trie of the tokens: children by byte, and at nodes that spell a token its number (from 1)
        self.texts, self.child, self.token = [b"", *self.parts], [{}], [0]
        for number, text in enumerate(self.texts[1:], 1):
            node = 0
            for byte in text:
                if byte not in self.child[node]:
                    self.child[node][byte] = len(self.child)
                    self.child.append({})
                    self.token.append(0)
                node = self.child[node][byte]
            self.token[node] = number
        self.fits: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple[tuple[int, int, int], ...]] = [((0, 0, 0),)]
        self.number = {self.states[0]: 0}
        self.move: list[dict[int, tuple[int, int]]] = [{}]

    def _compatible(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens can stand side by side: no pair over their border joins before each is complete.

        The test for adjacent tokens of Berglund and van der Merwe, Formalizing BPE Tokenization (2023), is the model.
        """
        rank, parts, far = self.rank, self.parts, 1 << 60
        a, b, limit = left, right, far
        while rank.get((a, b), far) >= limit:
            pa_, pb = parts[a], parts[b]
            ra, rb = (rank[pa_] if pa_ else -1), (rank[pb] if pb else -1)
            if ra < 0 and rb < 0:
                return True
            # undo the later of the two last merges; of equal ones the right one, as merges run from the left
            a, b, limit = (pa_[1], b, ra) if ra > rb else (a, pb[0], rb + 1)
        return False

    def _determinise(self, state: int, byte: int) -> tuple[int, int]:
        """Next state and emitted count.

        A state lists the positions from where a token may still go on: (trie node of the bytes since then,
        last token before it, tokens before it less tokens now), the earliest first.
        """
        token, count, alive = 0, 0, []
        for node, last, before in self.states[state]:
            after = self.child[node].get(byte)
            if after is None:
                continue
            if not token and (t := self.token[after]):  # the longest token that ends here and fits what stands before it
                fit = not last or self.fits.get(key := last << 17 | t)
                if fit is None:
                    if len(self.fits) > 1_000_000:
                        self.fits.clear()
                    fit = self.fits[key] = self._compatible(self.texts[last], self.texts[t])
                if fit:
                    token, count = t, before + 1
            if self.child[after]:
                alive.append((after, last, before))
        new = (*[(node, last, before - count) for node, last, before in alive], (0, token, 0))
        step = self.move[state][byte] = (self._number(new), count)
        return step

    def _number(self, state: tuple[tuple[int, int, int], ...]) -> int:
        found = self.number.get(state)
        if found is None:
            found = self.number[state] = len(self.states)
            self.states.append(state)
            self.move.append({})
        return found

    def count(self, word: bytes) -> int:
        state, total, move = 0, 0, self.move
        for b in word:
            step = move[state].get(b)
            if step is None:
                if len(self.states) > STATES:
                    here = self.states[state]
                    self.reset()
                    state, move = self._number(here), self.move
                step = self._determinise(state, b)
            state = step[0]
            total += step[1]
        return total


class Known(dict):
    """Counts of whole pre-tokens, that is of composed transitions."""

    def __init__(self, counter: Counter) -> None:
        super().__init__()
        self.counter = counter

    def __missing__(self, word: str) -> int:
        n = self.counter.count(word.encode())
        if len(word) <= WORD_CHARS:
            if len(self) > WORDS:
                self.clear()
            self[word] = n
        return n


class TokenCounter:
    """Compiled form of a byte-level BPE tokenizer file."""

    def __init__(self, tokenizer_json: str) -> None:
        with open(tokenizer_json, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        if not plain or model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{tokenizer_json}: a plain byte-level BPE tokenizer is needed")
        # byte-level files write each byte as a printable character; the order of the others is by rule
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        raw = lambda s: bytes(back[c] for c in s)
        added = {t["content"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{tokenizer_json}: added tokens that strip blanks are not supported")
        self.added = sorted(added, key=len, reverse=True)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.splitter = Splitter()
        self.known = Known(Counter({(raw(a), raw(b)): k for k, (a, b) in enumerate(merges)}))

    def words(self, text: str) -> list[str]:
        at = self.splitter.starts(text).tolist()
        return [text[i:j] for i, j in zip(at, [*at[1:], len(text)])]

    def count(self, text: str) -> int:
        total, parts = 0, [text]
        for special in self.added:
            cut = [p.split(special) for p in parts]
            total += sum(len(c) - 1 for c in cut)
            parts = [p for c in cut for p in c]
        return total + sum(sum(map(self.known.__getitem__, self.words(p))) for p in parts if p)


@lru_cache(maxsize=2)
def compiled(tokenizer_json: str) -> TokenCounter:
    """One counter for all tasks of a Python worker."""
    counter = TokenCounter(tokenizer_json)
    gc.freeze()  # the compiled tables hold no cycles: keep the collector from walking them
    gc.set_threshold(200_000, 50, 50)
    return counter


def count_tokens(docs: DataFrame, tokenizer_json: str, text: str = "text", limit: int = LIMIT, keep: list[str] | None = None) -> DataFrame:
    """docs[keep] plus n_bytes, n_tokens (long) and over_limit (boolean)."""
    keep = carried(docs, ("n_bytes", "n_tokens", "over_limit"), text) if keep is None else keep
    source = docs.select(*keep, docs[text].alias("__text"))
    schema = T.StructType([*[source.schema[c] for c in keep], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = compiled(tokenizer_json)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            n_bytes, n_tokens = [len(t.encode()) for t in texts], [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names=schema.names)

    return source.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str, tokenizer_json: str | None = None) -> DataFrame:
    """Tokens of every whole document under the 50k byte-level vocabulary."""
    if tokenizer_json is None:
        import public_tokenizers

        tokenizer_json = public_tokenizers.path("byte_bpe_50k.json")
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_json)


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLE: dict[str, str] = {}
