"""Pre-tokens and ids of public tokenizers.

``Pieces`` opens a tokenizer file once per worker. For byte-level BPE the
library encodes every pre-token on its own, so the ids of a text are the ids
of its pre-tokens in order; encoding each distinct pre-token once and reusing
the ids gives the library's own result. Characters up to U+017F are split
here by ``re``; a text with any other character is split by the library.
Tokenizers of another kind take the whole text as one pre-token.
"""

from __future__ import annotations

import re
from array import array

from ledgerloom.llm.common import ship, worker_state

ship(__name__)

# The pre-token pattern of byte-level BPE, with the classes
# \p{L}, \p{N} and \s spelled out for the characters that PLAIN lets pass.
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ſ"
NUMBER = "0-9²³¹¼-¾"
SPACE = r" \t\n\r"
PRE_TOKEN = (rf"'(?:[stmd]|re|ve|ll)| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+"
             rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
NOT_PLAIN = r"[^\t\n\r\x20-\x7e\xa1-ſ]"

#: Pre-tokens a worker remembers for good, and as many for a while, unless told otherwise; the longest one remembered.
KNOWN_TOKENS, CACHE_CHARS = 400_000, 64
#: After so many pre-tokens, the cache is renewed if more than this share was unknown.
STALE_AFTER, STALE_SHARE = 5_000_000, 0.3


def byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as one letter: printable ones as themselves, the others from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(others)}


LETTERS = byte_letters()
BLANK = LETTERS[0x20]


def as_letters(token: str) -> str:
    if token.isascii() and token.isprintable():
        return token.replace(" ", BLANK)
    return token.encode().decode("latin-1").translate(LETTERS)


class Pieces:
    """A tokenizer file: its pre-tokens, piece counts and ids."""

    def __init__(self, path: str, remembered: int = KNOWN_TOKENS):
        self.remembered = remembered
        self.path, self.known, self.young, self.merge = path, {}, {}, None
        self.seen = self.unknown = 0
        self.plain = None
        if path.endswith(".model"):
            import sentencepiece
            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.width = 2 if self.model.vocab_size() <= 1 << 16 else 4
            return
        import json
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.width = 2 if self.model.get_vocab_size(True) <= 1 << 16 else 4
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        simple = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in added)
        if (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                and not spec.get("normalizer") and simple):
            self.plain = re.compile(PRE_TOKEN)
            self.odd = re.compile(NOT_PLAIN)
            contents = sorted((t["content"] for t in added), key=len, reverse=True)
            self.contents = [c for c in contents if c]
            self.special = re.compile("(" + "|".join(map(re.escape, self.contents)) + ")")
            model = spec.get("model") or {}
            if model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges"):
                # the library's own model, without the library's way there: it takes the bytes as letters
                self.merge = self.model.model.tokenize
                self.special_ids = {c: [self.model.token_to_id(c)] for c in self.contents}

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens of a text in order; a special string is one of its own."""
        if self.plain is None:
            return [text] if text else []
        if any(c in text for c in self.contents):
            out = []
            for i, part in enumerate(self.special.split(text)):
                out += [part] if i % 2 else self._split(part)
            return out
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        if not self.odd.search(text):
            return self.plain.findall(text)
        return [text[a:b] for _, (a, b) in self.model.pre_tokenizer.pre_tokenize_str(text)]

    def ids(self, pre_tokens: list[str]) -> list[list[int]]:
        """Ids of each pre-token, from the library."""
        if self.path.endswith(".model"):
            return self.model.encode(pre_tokens, num_threads=1)
        if self.merge is None:
            return [e.ids for e in self.model.encode_batch_fast(pre_tokens, add_special_tokens=False)]
        special, merge = self.special_ids, self.merge
        return [special[t] if t in special else [p.id for p in merge(as_letters(t))] for t in pre_tokens]

    def counts(self, pre_tokens: list[str]) -> list[int]:
        return list(map(len, self.ids(pre_tokens)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts (null: empty), little-endian, ``width`` bytes each.

        Pre-tokens met once are remembered for a while, those met again for
        good, so that the many that never return don't displace the others.
        A full cache that no longer fits the texts starts anew.
        """
        known, young = self.known, self.young
        code = "H" if self.width == 2 else "I"
        out = []
        for at in range(0, len(texts), 32):
            toks = [self.pre_tokens(t) if t else [] for t in texts[at:at + 32]]
            parts = [list(map(known.get, own)) for own in toks]
            gaps = [[i for i, part in enumerate(own) if part is None] if None in own else [] for own in parts]
            missing = {own[i] for own, places in zip(toks, gaps) for i in places}
            if missing:
                found = {t: young[t] for t in missing if t in young}
                self.seen += sum(map(len, toks))
                self.unknown += sum(map(len, gaps))
                if self.seen > STALE_AFTER:
                    if self.unknown > STALE_SHARE * self.seen:
                        known.clear()
                    self.seen = self.unknown = 0
                if len(known) < self.remembered:
                    known.update(found)
                new = list(missing.difference(found))
                if new:
                    got = dict(zip(new, [array(code, ids).tobytes() for ids in self.ids(new)]))
                    if len(young) > self.remembered:
                        young.clear()
                    young.update(got if max(map(len, new)) <= CACHE_CHARS else
                                 {t: part for t, part in got.items() if len(t) <= CACHE_CHARS})
                    found |= got
                for own, places, chunk in zip(toks, gaps, parts):
                    for i in places:
                        chunk[i] = found[own[i]]
            out += map(b"".join, parts)
        return out


def pieces(path: str, remembered: int = KNOWN_TOKENS) -> Pieces:
    """The worker's own Pieces for a file."""
    held = worker_state("pieces")
    if path not in held:
        held[path] = Pieces(path)
    held[path].remembered = remembered
    return held[path]
