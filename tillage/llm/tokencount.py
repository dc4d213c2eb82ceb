"""Token counts by a compiled finite-state transducer (operator 3).

A byte-pair tokenizer is read from its file and compiled, state by state as texts need them, into a deterministic transducer over base
symbols. It rests on one fact about merge tables: a sequence of tokens is the encoding of its text exactly if every
adjacent pair is the encoding of its own two parts. So the last token of every prefix is unique, and it follows from the last tokens
of shorter prefixes that a longer token could still reach back to. A state is that short memory; a transition
carries the number of tokens that the new symbol adds to the count (it can be negative when a longer token swallows shorter ones).

White space sends every state to the start state. A text is cut into chunks; the map of a chunk from entry state to exit state
and count is held as what stands before its first white space, the count of what is enclosed, and what stands after the last one. These
maps compose associatively and are combined pairwise, as in a parallel prefix scan.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import id_and_text, map_batches, pieces

CHUNK = 1 << 16
# Words and states are remembered in every Python worker, up to these many; then the memory starts anew.
KNOWN_WORDS = 400_000
KNOWN_STATES = 300_000

_LETTERS = "\x1c\x1d\x1e\x1f"  # str.split() cuts here, the tokenizer's white space does not include them


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Transducer:
    """Counts the tokens of one word; states and transitions are made when first needed."""

    def __init__(self, vocab: Iterable[str], merges: list[tuple[str, str]], suffix: str):
        self.suffix, self.rank = suffix, {pair: i for i, pair in enumerate(merges)}
        self.letters = byte_letters()
        made = {a + b: (a, b) for a, b in merges}
        self.parts: dict[tuple[str, ...], str] = {}
        self.symbols: dict[str, tuple[str, ...]] = {}
        for token in vocab:
            self._spell(token, made)
        self.tokens = {s: t for t, s in self.symbols.items()}
        self.starts = {s[:k] for s in self.tokens for k in range(1, len(s))}
        self.whole: dict[str, bool] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.reset()

    def _spell(self, token: str, made: dict) -> tuple[str, ...]:
        """A token as base symbols; the word end belongs to the last symbol."""
        if token not in self.symbols:
            body = token.removesuffix(self.suffix) if self.suffix else token
            letters = list(body)
            if letters and len(body) < len(token):
                letters[-1] += self.suffix
            self.symbols[token] = tuple(letters) or (token,)
        return self.symbols[token]

    def reset(self) -> None:
        self.states: dict[tuple, int] = {((), (None,), (0,)): 0}
        self.memory: list[tuple] = [((), (None,), (0,))]
        self.next: list[dict[str, tuple[int, int]]] = [{}]

    def merge(self, symbols: tuple[str, ...]) -> list[str]:
        """The encoding by the merge table itself, lowest rank first. Used on one or two tokens only, to compile."""
        now = list(symbols)
        while len(now) > 1:
            best = min(range(len(now) - 1), key=lambda i: (self.rank.get((now[i], now[i + 1]), 1 << 40), i))
            pair = (now[best], now[best + 1])
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(now):
                if i + 1 < len(now) and (now[i], now[i + 1]) == pair:
                    out.append(now[i] + now[i + 1])
                    i += 2
                else:
                    out.append(now[i])
                    i += 1
            now = out
        return now

    def is_whole(self, token: str) -> bool:
        if token not in self.whole:
            self.whole[token] = self.merge(self.symbols[token]) == [token]
        return self.whole[token]

    def may_follow(self, left: str | None, right: str) -> bool:
        if left is None:
            return True
        key = (left, right)
        if key not in self.fits:
            self.fits[key] = self.merge(self.symbols[left] + self.symbols[right]) == [left, right]
        return self.fits[key]

    def _compile(self, state: int, symbol: str) -> tuple[int, int]:
        recent, last, counts = self.memory[state]
        for back in range(len(recent), -1, -1):  # a token of back + 1 symbols ends here
            at = len(last) - 1 - back
            token = self.tokens.get((*recent[len(recent) - back :], symbol))
            if token is not None and self.is_whole(token) and self.may_follow(last[at], token):
                break
        else:
            raise ValueError(f"no token for the symbol {symbol!r}")
        added = counts[at] + 1
        grown = (*recent, symbol)
        keep = next((k for k in range(len(grown), 0, -1) if grown[len(grown) - k :] in self.starts), 0)
        tokens = (*last, token)[len(last) - keep :]
        relative = tuple(c - added for c in (*counts, added)[len(counts) - keep :])
        memory = (grown[len(grown) - keep :], tokens, relative)
        target = self.states.get(memory)
        if target is None:
            target = self.states[memory] = len(self.memory)
            self.memory.append(memory)
            self.next.append({})
        self.next[state][symbol] = (target, added)
        return target, added

    def count(self, word: str) -> int:
        """Tokens of one pre-token (as text)."""
        if len(self.memory) > KNOWN_STATES:
            self.reset()
        letters = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
        if not letters:
            return 0
        letters[-1] += self.suffix
        state = total = 0
        for symbol in letters:
            step = self.next[state].get(symbol)
            state, added = step if step is not None else self._compile(state, symbol)
            total += added
        return total


class TokenCounter:
    """Counts tokens as the library does for a lower-casing, byte-level BPE file with word ends.

    Normalization: NFC, runs of white space, lower case. Special strings of the file inside a text count as one token each.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.machine = Transducer(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        splitter = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(splitter.replace(r"\s", r"\p{White_Space}")).findall
        self.space = regex.compile(r"\p{White_Space}+")
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.known: dict[str, int] = {"": 0}

    def _plain(self, text: str) -> int:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # one letter at a time: no final sigma
        return sum(self.machine.count(part) for part in self.find(text))

    def word(self, word: str) -> int:
        """Tokens of a piece of text without white space."""
        n = self.known.get(word)
        if n is None:
            if self.special and self.special.search(word):
                n = sum(self._plain(p) for p in self.special.split(word)) + len(self.special.findall(word))
            else:
                n = self._plain(word)
            if len(self.known) >= KNOWN_WORDS:
                self.known = {"": 0}
            if len(word) <= 64:
                self.known[word] = n
        return n

    def chunk(self, text: str) -> tuple[str, int, str | None]:
        """The state map of a chunk: (head, count, tail). Without white space all is head and the tail is None."""
        odd = any(c in text for c in _LETTERS)
        words = self.space.split(text) if odd else text.split()
        if not words or (len(words) == 1 and len(words[0]) == len(text)):
            return (text, 0, None) if text and words else ("", 0, "" if text else None)
        if not odd:
            words = ([""] if text[0].isspace() else []) + words + ([""] if text[-1].isspace() else [])
        known, total = self.known, 0
        for w in words[1:-1]:
            n = known.get(w)
            total += n if n is not None else self.word(w)
            known = self.known
        return words[0], total, words[-1]

    def join(self, a: tuple, b: tuple) -> tuple:
        """Compose the maps of two neighbouring chunks."""
        if a[2] is None:
            return (a[0] + b[0], b[1], b[2])
        if b[2] is None:
            return (a[0], a[1], a[2] + b[0])
        return (a[0], a[1] + self.word(a[2] + b[0]) + b[1], b[2])

    def text(self, text: str, chunk: int = CHUNK) -> int:
        maps = [self.chunk(p) for p in pieces(text, chunk)] or [("", 0, None)]
        while len(maps) > 1:
            maps = [self.join(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, n, tail = maps[0]
        return self.word(head) + n + (self.word(tail) if tail else 0)


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """One compiled tokenizer per Python worker and file."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every text: (id, n_bytes, n_tokens, over_limit). No shuffle.

    ``path`` is a tokenizer file every executor can read. A null text counts as empty: 0 bytes, 0 tokens. Rows are independent,
    so null or repeated ids come back as they are; an empty table gives an empty result. Texts of any length are counted whole.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batch: pa.RecordBatch) -> dict:
        count = counter(path).text
        return {"_id": batch.column(0), "n_bytes": batch.column(2), "n_tokens": [count(t) for t in batch.column(1).to_pylist()]}

    rows = id_and_text(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("_text").cast("long"))
    out = map_batches(rows, run, f"_id {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
