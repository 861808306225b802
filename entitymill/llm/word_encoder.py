"""Ids of a word tokenizer, word by word, with words seen before kept."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import lru_cache
from unicodedata import normalize

import numpy as np
from tokenizers import Tokenizer, models, pre_tokenizers

# One ASCII mark (but no apostrophe, with which contractions start) behind a small letter, ASCII
# or Latin-1, and before white space is a unit of its own. Marks are fewer than letters, so they
# are what the pattern looks for first.
TAIL = re.compile(rb"[!-&(-/:-@\[-`{-~](?=\s|\Z)(?:(?<=[a-z].)|(?<=\xc3[\x9f-\xb6\xb8-\xbf].))")
# Byte-level models write a byte that is no printable character as one from U+0100 on.
_UNPRINTABLE = [*range(0, 33), *range(127, 161), 173]
BYTE_CHARACTERS = {b: 256 + k for k, b in enumerate(_UNPRINTABLE)}


class WordEncoder:
    """Ids of a tokenizer that lower-cases and never joins text across white space, word by word.

    The tokenizer parts letters from other characters, so a word of letters is one unit
    to it, closed by an id that ends a word; many such words go into one call. Those that
    its normalising leaves alone need only its model, split at blanks. Ids of words seen
    are kept, two generations of about ``most`` words each.
    """

    def __init__(self, path: str, most: int = 300_000):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # New words are all distinct, so the model's own cache would only cost time.
        bare = models.BPE(model["vocab"], merges, cache_capacity=0, end_of_word_suffix=model["end_of_word_suffix"])
        self.bare = Tokenizer(bare)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(model["end_of_word_suffix"])]] = True
        self.most, self.new, self.old = most, {}, {}

    def _one_unit_each(self, tokenizer: Tokenizer, keys: list[bytes], texts: list[bytes], run: int = 5_000) -> None:
        """Learn ``keys`` from ``texts``, each of which ``tokenizer`` takes as one unit."""
        for k in range(0, len(keys), run):
            joined = b" ".join(texts[k : k + run]).decode()
            ids = np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u2")
            stops = (2 * np.flatnonzero(self.ends[ids]) + 2).tolist()
            if len(stops) != len(keys[k : k + run]):
                raise ValueError("the tokenizer doesn't take letters as one unit")
            raw = ids.tobytes()
            pieces = [raw[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]
            self.new.update(zip(keys[k : k + run], pieces, strict=True))

    def _learn(self, words: set[bytes]) -> None:
        """Afterwards all ``words`` are in the new generation."""
        again = words.intersection(self.old)
        self.new.update((w, self.old[w]) for w in again)
        words -= again
        # Neither normalising nor splitting changes small ASCII letters.
        plain = [w for w in words if w.isalpha() and w.islower()]
        self._one_unit_each(self.bare, plain, plain)
        alike, characters, cased, others = [], [], [], []
        for word in words.difference(plain):
            text = word.decode("utf-8", "replace")
            lower = normalize("NFC", text).lower()
            # What normalising turns into more than letters is left to the tokenizer as it stands.
            if not (text.isalpha() and lower.isalpha()):
                others.append(word)
            elif lower != text:
                cased.append(word)
            else:  # The model takes bytes as characters.
                alike.append(word)
                characters.append(word.decode("latin-1").translate(BYTE_CHARACTERS).encode())
        self._one_unit_each(self.bare, alike, characters)
        self._one_unit_each(self.tokenizer, cased, cased)
        for word in others:
            ids = self.tokenizer.encode_batch_fast([word.decode("utf-8", "replace")], add_special_tokens=False)[0].ids
            self.new[word] = np.array(ids, "<u2").tobytes()

    def encode_all(self, texts: Sequence[bytes | None], block: int = 200_000) -> list[bytes]:
        """Ids of every text (None: empty) as little-endian unsigned 16-bit numbers.

        Words are looked up in runs of about ``block``, over short texts and inside long ones.
        """
        out, run, size = [[] for _ in texts], [], 0
        for i, raw in enumerate(texts):
            raw = raw or b""
            if not (b"\xcc" in raw or b"\xcd" in raw or b"<|" in raw):
                # Without special tokens, and without marks (U+0300 to U+037F) that would join a
                # letter differently in either case, ASCII letters may be lower-cased first.
                raw = TAIL.sub(rb" \g<0>", raw.lower())
            words = raw.split()
            for a in range(0, len(words), block):
                run.append((i, words[a : a + block]))
                size += len(run[-1][1])
                if size >= block:
                    self._look_up(run, out)
                    run, size = [], 0
        self._look_up(run, out)
        return [b"".join(parts) for parts in out]

    def _look_up(self, run: list[tuple[int, list[bytes]]], out: list[list[bytes]]) -> None:
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        unknown = set().union(*(words for _, words in run)).difference(self.new)
        if unknown:
            self._learn(unknown)
        ids = self.new.__getitem__
        for i, words in run:
            out[i].append(b"".join(map(ids, words)))

    def encode(self, raw: bytes, block: int = 200_000) -> bytes:
        return self.encode_all([raw], block)[0]


@lru_cache(maxsize=1)
def shared_encoder(path: str) -> WordEncoder:
    """One encoder per Python worker; its words serve all tasks that the worker runs."""
    return WordEncoder(path)
