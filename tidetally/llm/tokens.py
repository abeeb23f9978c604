"""Token ids of whole texts, worked out once per distinct word.

The public word tokenizer drops white space and none of its tokens crosses it,
so a text's ids are its words' ids in a row. Each Python worker keeps the ids of
words it has met; every id comes from the tokenizers library.
"""

import re
from array import array

import public_tokenizers
from tokenizers import Tokenizer, pre_tokenizers

from tidetally.llm.batches import stage_table

WORD_BPE = "word_bpe_49k.json"

#: Words, and lower-case runs of letters, that a worker keeps in each of two generations.
KEPT_WORDS = 450_000
KEPT_RUNS = 400_000

#: Longer words are worked out each time they occur.
LONGEST_KEPT = 64

#: Lower-case letters that composing leaves alone, and marks that form one run after them.
LETTERS = re.compile("[a-zß-öø-ÿ]+")
MARKS = ".,;:!?%&$#*|"

#: White space to Python and not to the library; texts with one are cut at plain spaces only.
SEPARATORS = "\x1c\x1d\x1e\x1f"
SPACES = re.compile("[ \t\n\r]+")


class Recent(dict):
    """Values by text; when full, those not asked for in a whole generation go."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most
        self.older: dict[str, bytes] = {}

    def __missing__(self, text: str) -> bytes:
        value = self.older.get(text)
        if value is None:
            value = self.work_out(text)
        if len(text) <= LONGEST_KEPT:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[text] = value
        return value


class RunIds(Recent):
    """The ids of one lower-case run of letters, or of marks."""

    def __init__(self, path: str):
        super().__init__(KEPT_RUNS)
        tokenizer = Tokenizer.from_file(path)
        tokenizer.normalizer = None
        tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.tokenizer = tokenizer
        self.model = tokenizer.model

    def work_out(self, text: str) -> bytes:
        if text.isascii():  # bytes that stand for themselves
            return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


class WordIds(Recent):
    """Word to the bytes of its ids (unsigned 32 bits)."""

    def __init__(self, path: str):
        super().__init__(KEPT_WORDS)
        self.whole = Tokenizer.from_file(path)
        self.runs = RunIds(path)

    def work_out(self, word: str) -> bytes:
        letters = word.rstrip(MARKS)
        known = letters in self.runs or letters in self.runs.older
        if known or LETTERS.fullmatch(letters):
            marks = word[len(letters) :]
            return self.runs[letters] + self.runs[marks] if marks else self.runs[letters]
        return array("I", self.whole.encode(word, add_special_tokens=False).ids).tobytes()

    def of(self, text: str | None) -> bytes:
        """The ids of a whole text (null: none), as bytes."""
        if not text:
            return b""
        # Within Latin-1 lower-casing goes letter by letter, so it can come first; the names of
        # special tokens, though, are looked for in the text as it is.
        if "<|" not in text and len(text.encode("latin-1", "ignore")) == len(text):
            text = text.lower()
        odd = any(mark in text for mark in SEPARATORS)
        words = SPACES.split(text) if odd else text.split()
        return b"".join(map(self.__getitem__, words))


def word_ids(path: str | None = None) -> WordIds:
    """This worker's table of words, kept while its stage runs."""
    return stage_table(("words", path), lambda: WordIds(path or public_tokenizers.path(WORD_BPE)))
