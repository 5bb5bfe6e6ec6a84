"""Token ids of whole texts with a public tokenizer of the ``tokenizers`` library, fast on repeated words."""

from __future__ import annotations

import os

import numpy as np

#: Vocabulary with word ends: lower case, white space dropped. See the folder's README.
WORD_BPE = "word_bpe_49k.json"
#: Ends of words that are one run of ASCII punctuation after a letter. Apostrophes (contractions) and "<" are left out.
TAIL = b'!"#$%&()*+,-./:;=>?@[]^_`{|}~\\'


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the n-th other byte as code point 256 + n."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(other)}


class WordEncoder:
    """Encodes texts word by word, keeping the ids of words already met.

    The vocabulary's rules never join characters across ASCII white space, so a text's ids are its words' ids in a row. A new word of
    Latin letters, with or without punctuation after them, is lowered and given to the library's BPE model, which is what
    the tokenizer does with it after longer preparation; any other word goes to the tokenizer whole. Ids are little-endian
    unsigned 32-bit integers. What is kept is bounded by ``keep_bytes`` and then begun anew.
    """

    def __init__(self, path: str, keep_bytes: int = 120 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.keep_bytes, self.kept = keep_bytes, 0
        self.words: dict[bytes, bytes] = {}
        self.tails: dict[bytes, bytes] = {b"": b""}

    @staticmethod
    def shared(path: str) -> WordEncoder:
        """One encoder for all tasks of a Python worker, so that a task finds the words that earlier ones met."""
        import tokenizers
        kept = tokenizers.__dict__.setdefault("_encoders_by_path", {})
        if path not in kept:
            kept[path] = WordEncoder(path)
        return kept[path]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def run(self, letters: str) -> bytes:
        """Ids of one run of letters or of punctuation, written in the vocabulary's letters."""
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(letters)])

    def new(self, word: bytes) -> bytes:
        if b"<|" in word:
            return self.whole(word.decode())
        low = word.lower()
        stem = low.rstrip(TAIL)
        if stem.isalpha():
            ids = self.run(stem.decode())
        else:
            text = stem.decode()
            if not (text.isalpha() and max(text) < "ɐ" and "İ" not in text):
                return self.whole(word.decode())
            letters = self.letters
            ids = self.run("".join([letters[b] for b in text.lower().encode()]))
        if len(stem) == len(low):
            return ids
        tail = low[len(stem):]
        if tail not in self.tails:
            if len(self.tails) > 10_000:
                self.tails.clear()
            self.tails[tail] = self.run(tail.decode())
        return ids + self.tails[tail]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, as bytes."""
        out, known = [], self.words
        for text in texts:
            words = text.split()
            ids = list(map(known.get, words))
            if None in ids:
                for k, own in enumerate(ids):
                    if own is None:
                        word = words[k]
                        own = known.get(word)
                        if own is None:
                            own = known[word] = self.new(word)
                            self.kept += len(word) + len(own) + 150
                        ids[k] = own
                if self.kept > self.keep_bytes:
                    known.clear()
                    self.kept = 0
            out.append(b"".join(ids))
        return out
