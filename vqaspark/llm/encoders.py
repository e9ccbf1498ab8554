"""Token ids by a public vocabulary, looked up by word.

A text whose characters all lie in the plain Latin range splits at white space into units that the vocabulary's rules treat
apart from each other.  A batch's distinct units are found by Arrow's dictionary encoding, each goes through the tokenizer
once, and numpy puts the ids of the texts together.  Units of letters alone are one pre-token each, so that the library gets
many in one string and its model does nothing but merge.  Any other text (other scripts, combining marks, special strings,
runs of blanks) goes through the tokenizer whole.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that neither compose, nor change length in lower case, nor count as white space for one library only.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-įĲ-ňŊ-ſ]*")
CACHE_UNITS = 400_000
#: Rows and bytes of the texts that are encoded together: what a batch shares is looked up once.
BATCH_TEXTS, BATCH_BYTES = 4000, 8 << 20


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


LETTER, PUNCTUATION = "[A-Za-zÀ-ÖØ-öø-ſ]", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words of letters that go through the tokenizer in one string.
GROUP = 128


def byte_signs() -> np.ndarray:
    """The code point that stands for each byte in byte-level vocabularies: printable signs of Latin-1 for themselves, then from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = np.zeros(256, "<u4")
    table[own] = own
    table[table == 0] = 256 + np.arange(256 - len(own))
    return table


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of flat that index names, one after the other, and where each ends (from 0)."""
    lengths = sizes[index]
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    number = np.int32 if ends[-1] < 1 << 31 else np.int64
    at = np.repeat((starts[index] - ends[:-1]).astype(number), lengths)
    at += np.arange(ends[-1], dtype=number)
    return flat[at], ends


@functools.cache
def encoder(path: str) -> CachedEncoder:
    """One per worker process, as a vocabulary takes time to load."""
    return CachedEncoder(path)


class CachedEncoder:
    """encode(texts) gives each text's ids as little-endian unsigned 16-bit bytes, as the library without added tokens."""

    #: No unit's ids are remembered from one batch to the next.
    units = older = ()

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.merger = type(self.tokenizer)(self.tokenizer.model)  # the same model, for words that need nothing before it
        self.by_blank = self.tokenizer.normalizer is None  # byte level: the blank belongs to the word after it
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        if len(vocabulary) > 65_536:
            raise ValueError("ids need more than 16 bits")
        # in a joined string, ids that begin with a blank are the first of each word; or those with the suffix the last
        self.edge = np.zeros(65_536, bool)
        self.edge[[i for token, i in vocabulary.items() if (token.startswith("Ġ") if self.by_blank else token.endswith("</w>"))]] = True
        self.signs = byte_signs()
        if self.by_blank:
            # no merge reaches over a blank: a token with one inside also holds a byte C2, which no letter of LETTER has
            self.joins = not any("Ġ" in token.lstrip("Ġ") and "Â" not in token for token in vocabulary)
        else:
            from tokenizers.pre_tokenizers import WhitespaceSplit

            self.joins = self.tokenizer.model.end_of_word_suffix == "</w>"
            self.merger.pre_tokenizer, self.signs[32] = WhitespaceSplit(), 32

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _plain(self, text: str) -> bool:
        if not PLAIN.fullmatch(text) or "<|" in text:
            return False
        return not self.by_blank or not ("  " in text or "\n " in text or "\r " in text or "\t " in text or text[-1:] == " " or text[:1] == " ")

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words of letters, one after the other, and how many each has.  The library's model merges; what it does before is done here for all."""
        groups = pa.ListArray.from_arrays(pa.array([*range(0, len(words), GROUP), len(words)], pa.int32()), words.cast(pa.string()))
        lead = " " if self.by_blank else ""
        strings = [self.signs[np.frombuffer((lead + g).encode(), np.uint8)].tobytes().decode("utf-32-le") for g in pc.binary_join(groups, pa.scalar(" ")).to_pylist()]
        found = self.merger.encode_batch_fast(strings, add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, "<u2"), *(np.array(e.ids, "<u2") for e in found)])
        edges = np.flatnonzero(self.edge[ids])
        if len(edges) != len(words):
            raise ValueError("a word's ids do not show where it stands")
        return ids, np.diff(edges, append=len(ids)) if self.by_blank else np.diff(edges, prepend=-1)

    def _unit_ids(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct units (at byte level with the blank before each): all ids, and where each unit's start and how many they are.

        No object is made for a unit.  Signs after a unit's last letter are pre-tokens of their own and taken off, so that
        units meet in their words.
        """
        core = pc.utf8_rtrim(units, characters=PUNCTUATION)
        core = pc.if_else(pc.match_substring_regex(core, f"{LETTER}$"), core, units)
        tailed = pc.not_equal(pc.binary_length(core), pc.binary_length(units))
        tails = pc.replace_substring_regex(units.filter(tailed), f"(?s)^.*{LETTER}", "").dictionary_encode()
        coded = core.dictionary_encode()
        simple = pc.and_(pc.match_substring_regex(coded.dictionary, f"^{LETTER}+$"), self.joins)
        many, counts = self._word_ids(coded.dictionary.filter(simple))
        lead = " " if self.by_blank else ""
        other = [*(lead + u for u in coded.dictionary.filter(pc.invert(simple)).to_pylist()), *tails.dictionary.to_pylist(), ""]
        single = [np.array(e.ids, "<u2") for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
        flat = np.concatenate([many, *single])
        sizes = np.concatenate([counts, np.fromiter(map(len, single), np.int64, len(single))])
        starts = np.cumsum(sizes) - sizes
        # each unit is its word, and what follows it (by default the last piece, which is empty)
        mask, place = simple.to_numpy(zero_copy_only=False), np.empty(len(simple), np.int64)
        place[mask], place[~mask] = np.arange(len(counts)), len(counts) + np.arange(len(mask) - len(counts))
        pieces = np.full((len(units), 2), len(sizes) - 1)
        pieces[:, 0] = place[coded.indices.to_numpy(zero_copy_only=False)]
        pieces[tailed.to_numpy(zero_copy_only=False), 1] = len(place) + tails.indices.to_numpy(zero_copy_only=False)
        ids, ends = gathered(flat, starts, sizes, pieces.ravel())
        return ids, ends[:-1:2], np.diff(ends[::2])

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [i for i, t in enumerate(texts) if self._plain(t)]
        if self.by_blank:
            split = [texts[i].partition(" ") for i in plain]
            # what follows the first blank; a first word has no blank before it and goes through the tokenizer with its like
            heads = [array("H", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast([s[0] for s in split], add_special_tokens=False)]
            listed = pc.split_pattern(pa.array([s[2] if s[1] else None for s in split], pa.large_string()), " ")
        else:
            heads = [b""] * len(plain)
            listed = pc.ascii_split_whitespace(pa.array([texts[i].lower() for i in plain], pa.large_string()))
        coded = listed.flatten().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        flat, starts, sizes = self._unit_ids(coded.dictionary)
        ids, ends = gathered(flat, starts, sizes, index)
        whole = ids.tobytes()
        # a list of no words (null) has no place of its own
        words = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = (2 * ends[np.concatenate([[0], np.cumsum(words)])]).tolist()
        out: list[bytes] = [b""] * len(texts)
        for i, head, a, b in zip(plain, heads, bounds[:-1], bounds[1:], strict=True):
            out[i] = head + whole[a:b]
        for i in set(range(len(texts))).difference(plain):
            out[i] = array("H", self._ids(texts[i])).tobytes()
        return out
