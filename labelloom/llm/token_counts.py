"""Token counts by a compiled finite-state transducer.

The tokenizer file (normalizer, split rule, BPE merges with word ends) is compiled, transition by
transition as texts need them, into a deterministic transducer over characters whose transitions carry
the number of tokens that they add (a merge across the new character makes it 0 or negative). A state
holds what can still matter: the mode of the split rule, the byte that may turn out to be the last of
its word, and for the characters since the earliest token that may still grow, the last token of each
prefix and how many tokens that prefix has less. White space brings the machine back to its start, so
the map of a chunk of text is (head, count, tail): the counts of its complete fields and two open ends.
Maps compose associatively; `scan` composes those of all chunks of a text pairwise, level by level. The
maps of single fields are kept, as composed transitions, in a bounded store.

Defined results: null text counts 0 tokens and 0 bytes; ids may be null or repeated.
"""

from __future__ import annotations

import json
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import map_slices, one_per_worker

#: Bounds of the stores of one worker: states, transitions, pair tests, fields (twice) and their length.
STATES_KEPT, MOVES_KEPT, PAIRS_KEPT, FIELDS_KEPT, FIELD_CHARS = 200_000, 600_000, 400_000, 400_000, 32
#: Characters of a chunk whose map is computed on its own.
CHUNK = 1 << 16
#: The split rule and normalizer that this compiler knows; fixed values of the tokenizer file.
SPLIT_RULE = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]

START, LETTERS, OTHERS, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(7)
_AFTER_QUOTE = {"r": QUOTE_R, "v": QUOTE_V, "l": QUOTE_L}
_SHORT_FORM = {QUOTE_R: "e", QUOTE_V: "e", QUOTE_L: "l"}
_HELD = {QUOTE_R: "r", QUOTE_V: "v", QUOTE_L: "l"}
#: Python calls these white space, the rule does not.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_LAST = 256  # added to the code of a byte that ends its word
EMPTY = ("", ("",), (0,))


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable bytes as they are, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class CountingTransducer:
    def __init__(self, tokenizer_json: bytes):
        spec = json.loads(tokenizer_json)
        model, normal, split = spec["model"], spec["normalizer"], spec["pre_tokenizer"]
        found = [n["type"] for n in normal["normalizers"]]
        rule = split["pretokenizers"][0]["pattern"]["Regex"]
        suffix = model["end_of_word_suffix"]
        if found != NORMALIZERS or rule != SPLIT_RULE or not suffix:
            raise ValueError("this tokenizer's normalizer or split rule is not known to the compiler")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        letters = byte_letters()

        def symbols(token: str) -> str:
            ends = token.endswith(suffix) and token != suffix
            codes = [letters[c] for c in (token[: -len(suffix)] if ends else token)]
            return "".join(map(chr, codes[:-1])) + chr(codes[-1] + _LAST * ends)

        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(symbols(a), symbols(b)): k for k, (a, b) in enumerate(merges)}
        self.tokens = {symbols(t) for t in model["vocab"]}
        self.longest = max(map(len, self.tokens))
        self.openings = {t[:k] for t in self.tokens for k in range(1, len(t))}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.fields: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[str, tuple[int, int]]] = []
        self.ends: dict[int, int] = {}
        self.pushed: dict[tuple, tuple] = {}
        self.made = 0
        self.number((START, EMPTY, -1))

    def number(self, state: tuple) -> int:
        known = self.numbers.get(state)
        if known is None:
            known = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        return known

    # The word machine: its states are (recent symbols, last token of each recent prefix, counts below the current).

    def merged(self, text: str) -> list[str]:
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = min((rank.get((parts[k], parts[k + 1]), 1 << 60), k) for k in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def agrees(self, left: str, right: str) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            known = (left, right) not in self.rank and self.merged(left + right) == ([left, right] if left else [right])
            self.pairs[left, right] = known
        return known

    def push(self, word: tuple, symbol: str) -> tuple[tuple, int]:
        known = self.pushed.get((word, symbol))
        if known is not None:
            return known
        recent, last, below = word
        recent += symbol
        for size in range(len(recent), 0, -1):
            token, at = recent[-size:], len(recent) - size
            if token in self.tokens and (last[at] or at == 0 and not last[0]) and self.agrees(last[at], token):
                break
        added = below[at] + 1
        last, below = (*last, token), (*(b - added for b in below), 0)
        keep = len(recent)
        while keep and recent[-keep:] not in self.openings:
            keep -= 1
        out = ((recent[len(recent) - keep :], last[-keep - 1 :], below[-keep - 1 :]), added)
        self.pushed[word, symbol] = out
        return out

    # The split rule around it.

    def spelled(self, word: tuple, held: int, text: str) -> tuple[tuple, int, int]:
        added = 0
        for byte in text.encode("utf-8", "replace"):
            if held >= 0:
                word, more = self.push(word, chr(held))
                added += more
            held = byte
        return word, held, added

    def closed(self, word: tuple, held: int) -> int:
        return self.push(word, chr(held + _LAST))[1] if held >= 0 else 0

    def whole(self, text: str) -> int:
        word, held, added = self.spelled(EMPTY, -1, text)
        return added + self.closed(word, held)

    def step(self, state: tuple, char: str) -> tuple[tuple, int]:
        mode, word, held = state
        kind = _kind(char)
        if mode == QUOTE:
            if char in "stmd":
                return (START, EMPTY, -1), self.whole("'" + char)
            if char in _AFTER_QUOTE:
                return (_AFTER_QUOTE[char], EMPTY, -1), 0
            word, held, added = self.spelled(EMPTY, -1, "'")
            after, more = self.step((OTHERS, word, held), char)
            return after, added + more
        if mode in _SHORT_FORM:
            if char == _SHORT_FORM[mode]:
                return (START, EMPTY, -1), self.whole("'" + _HELD[mode] + char)
            word, held, added = self.spelled(EMPTY, -1, _HELD[mode])
            after, more = self.step((LETTERS, word, held), char)
            return after, self.whole("'") + added + more
        if mode == LETTERS and kind == "L" or mode == OTHERS and kind == "O":
            word, held, added = self.spelled(word, held, char)
            return (mode, word, held), added
        done = self.closed(word, held) if mode != START else 0
        if kind == "S":
            return (START, EMPTY, -1), done
        if kind == "N":
            return (START, EMPTY, -1), done + self.whole(char)
        if char == "'":
            return (QUOTE, EMPTY, -1), done
        word, held, added = self.spelled(EMPTY, -1, char)
        return (LETTERS if kind == "L" else OTHERS, word, held), done + added

    def ended(self, state: tuple) -> int:
        mode, word, held = state
        if mode == QUOTE:
            return self.whole("'")
        if mode in _HELD:
            return self.whole("'") + self.whole(_HELD[mode])
        return self.closed(word, held)

    def run(self, text: str) -> int:
        """Tokens of a normalized text from the start state to its end: the machine, character by character."""
        if len(self.states) > STATES_KEPT or self.made > MOVES_KEPT or len(self.pushed) > MOVES_KEPT:
            self._forget()
        at, total, moves = 0, 0, self.moves
        for char in text:
            move = moves[at].get(char)
            if move is None:
                if len(self.states) > 2 * STATES_KEPT:  # within one very long field
                    state = self.states[at]
                    self._forget()
                    moves, at = self.moves, self.number(state)
                after, added = self.step(self.states[at], char)
                move = moves[at][char] = (self.number(after), added)
                self.made += 1
            at, added = move
            total += added
        end = self.ends.get(at)
        if end is None:
            end = self.ends[at] = self.ended(self.states[at])
        return total + end

    # Chunk maps.

    def field(self, text: str) -> int:
        """The map of a field between white space: the composed transitions from start to end."""
        known = self.fields.get(text)
        if known is None:
            known = self.older.get(text)
            if known is None:
                known = self.run(text)
            if len(text) <= FIELD_CHARS:
                if len(self.fields) >= FIELDS_KEPT:
                    self.older, self.fields = self.fields, {}
                self.fields[text] = known
        return known

    def total(self, fields: list[str]) -> int:
        counts = list(map(self.fields.get, fields))
        if None in counts:
            return sum(self.field(f) if c is None else c for f, c in zip(fields, counts, strict=True))
        return sum(counts)

    def chunk_map(self, chunk: str) -> tuple[str, int, str | None]:
        """(head, count, tail); tail is None where the chunk has no white space and is all head."""
        fields = _fields(chunk)
        if len(fields) == 1:
            return fields[0], 0, None
        return fields[0], self.total(fields[1:-1]), fields[-1]

    def compose(self, one: tuple, two: tuple) -> tuple:
        if one[2] is None:
            return one[0] + two[0], two[1], two[2]
        if two[2] is None:
            return one[0], one[1], one[2] + two[0]
        return one[0], one[1] + self.field(one[2] + two[0]) + two[1], two[2]

    def scan(self, maps: list[tuple]) -> int:
        while len(maps) > 1:
            paired = [self.compose(*maps[k : k + 2]) for k in range(0, len(maps) - 1, 2)]
            maps = paired + maps[len(maps) & ~1 :]
        head, count, tail = maps[0]
        return count + self.field(head) + (self.field(tail) if tail is not None else 0)

    def count(self, text: str) -> int:
        total, at = 0, 0
        if "<" in text:
            for special in self.special.finditer(text):
                total += 1 + self.plain(text[at : special.start()])
                at = special.end()
        return total + self.plain(text[at:] if at else text)

    def plain(self, text: str) -> int:
        text = _lower(unicodedata.normalize("NFC", text))
        if len(text) <= CHUNK and not _NOT_SPACE.search(text):
            return self.total(text.split())
        return self.scan([self.chunk_map(text[k : k + CHUNK]) for k in range(0, len(text), CHUNK)])


def _kind(char: str) -> str:
    if char.isspace() and not "\x1c" <= char <= "\x1f":
        return "S"
    first = unicodedata.category(char)[0]
    return first if first in "LN" else "O"


def _lower(text: str) -> str:
    """Each character for itself: no rule for a sigma at the end of a word."""
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


_SPLIT = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def _fields(chunk: str) -> list[str]:
    return _SPLIT.split(chunk)


def transducer_of(tokenizer_json: bytes) -> CountingTransducer:
    return one_per_worker(CountingTransducer, tokenizer_json)


def count_tokens(df: DataFrame, tokenizer_json: bytes, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: its id, `n_bytes` (UTF-8) and `n_tokens`. A map over the scan: no shuffle."""
    kind = df.schema[id_column].dataType.simpleString()

    def make():
        machine = transducer_of(tokenizer_json)

        def apply(batch):
            texts = batch.column(2).to_pylist()
            return [batch.column(0), batch.column(1), [machine.count(t or "") for t in texts]]

        return apply

    text = F.col(text_column).cast("string")
    narrow = df.select(F.col(id_column), F.coalesce(F.octet_length(text).cast("bigint"), F.lit(0)).alias("n_bytes"), text)
    return map_slices(narrow, make, f"`{id_column}` {kind}, n_bytes bigint, n_tokens bigint")


def over_limit(df: DataFrame, tokenizer_json: bytes, limit: int = 2048) -> DataFrame:
    return count_tokens(df, tokenizer_json).withColumn("over_limit", F.col("n_tokens") > limit)
