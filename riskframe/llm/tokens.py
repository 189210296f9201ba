"""Token ids and counts from public tokenizer files, a stretch of text at a time.

Both vocabularies cut a text before they merge, and the cuts depend only on a run
of white space and the run of other characters behind it. Equal stretches
therefore give equal ids, and each distinct stretch is tokenized once.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

#: Unicode White_Space, which is what \\s means to the tokenizer library.
WHITE = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + f"{chr(0x2000)}-{chr(0x200A)}"
#: A run of white space with the run of other characters behind it, or the last white space.
STRETCH = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Marks at the end of a word, behind a digit or a letter of a-z or Latin-1; the
#: apostrophe is left, as it can go with the letter behind it. A pattern that begins
#: with the mark itself is sought much faster than one that begins with the letter.
END_MARKS = re.compile(rb"[!-&(-/:-@\[-`{-~](?:(?<=[0-9a-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))[!-&(-/:-@\[-`{-~]*(?=[ \t-\r]|\Z)", re.DOTALL)
#: Words of small letters of a-z and Latin-1, which normalising leaves as they are.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: Stretches that a worker remembers, from task to task; the memory is emptied when
#: full. Longer ones are not remembered.
MEMORY, LONGEST = 600_000, 64


def load(path: str) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class WordIds:
    """Ids of a text under a vocabulary that drops white space, lower-cases, and cuts
    runs of letters from runs of marks: words between ASCII white space do not affect
    each other, nor do a word and the marks behind it. So A-Z are lower-cased and
    marks at a word's end taken off first, and fewer distinct words are left. Plain
    lower-case words go straight to the model, as nothing is left to normalise."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        added = self.tokenizer.get_added_tokens_decoder().values()
        #: Texts with these stay as written: strings of added tokens keep their case,
        #: and a dot above (U+0307) makes another small letter of a capital I.
        self.as_written = sorted({t.content.encode()[:1] for t in added} | {b"\xcc\x87"})
        self.known: dict[bytes, bytes] = {}

    def words(self, text: bytes) -> list[bytes]:
        if not any(c in text for c in self.as_written):
            text = END_MARKS.sub(rb" \g<0>", text.lower())
        return text.split()

    def of(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; no special tokens are added."""
        words = [self.words(t) for t in texts]
        seen: set[bytes] = set().union(*words)
        new = seen.difference(self.known)
        if len(self.known) + len(new) > MEMORY:
            self.known = {w: self.known[w] for w in seen.difference(new)}
        known = self.known
        easy = [w for w in new if PLAIN.fullmatch(w)]
        for tokenizer, some in ((self.plain, easy), (self.tokenizer, list(new.difference(easy)))):
            for start in range(0, len(some), 4096):
                part = some[start:start + 4096]
                coded = tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)
                known.update((w, array("I", e.ids).tobytes()) for w, e in zip(part, coded, strict=True))
        out = [b"".join(map(known.__getitem__, ws)) for ws in words]
        for w in [w for w in new if len(w) > LONGEST]:
            del known[w]
        if len(known) > MEMORY:
            known.clear()
        return out

    def ids(self, text: bytes) -> bytes:
        return self.of([text])[0]


class PreTokens:
    """Pre-tokens of a stretch, as the library cuts it; strings of added tokens
    are taken out first, as the library does, and stand for themselves."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.known: dict[str, tuple[str, ...]] = {}

    def of(self, stretch: str) -> tuple[str, ...]:
        found = self.known.get(stretch)
        if found is None:
            parts = self.cut.split(stretch) if self.cut and "<" in stretch else [stretch]
            out: list[str] = []
            for k, part in enumerate(parts):
                if k % 2:
                    out.append(part)
                elif part:
                    cuts = [part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
                    out += cuts if "".join(cuts) == part else [part]
            found = tuple(out)
            if len(stretch) <= LONGEST:
                if len(self.known) >= MEMORY:
                    self.known.clear()
                self.known[stretch] = found
        return found


def piece_counts(tokenizer: Tokenizer, pre_tokens: list[str]) -> list[int]:
    """Number of pieces of each pre-token."""
    return [len(e.ids) for e in tokenizer.encode_batch_fast(pre_tokens, add_special_tokens=False)]


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """The worker's own, kept between tasks."""
    return WordIds(path)


@lru_cache(maxsize=1)
def pre_tokens(path: str) -> PreTokens:
    return PreTokens(path)
