"""What a tokenizer file of byte-level merges holds, read once per Python worker."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field



#: White space as Unicode has it; the control characters 1C to 1F are not part of it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


#: Letters and digits that are newer than Unicode 16, the version the tokenizer files are used with.
NEWER = """
    558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF
    10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F
    12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2
    18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF
    1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E
    2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
NEWER_CLASS = "".join(
    f"\\U{int(a, 16):08x}-\\U{int(b or a, 16):08x}" for a, _, b in (x.partition("-") for x in NEWER.split())
)
_NEWER_CHARACTER = re.compile(f"[{NEWER_CLASS}]")

#: Capitals newer than Python's own tables, with their small letters.
CAPITALS = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB,
    0xA7DC: 0x19B, **{0x10D50 + k: 0x10D70 + k for k in range(22)}, **{0x16EA0 + k: 0x16EBB + k for k in range(25)},
}
_CAPITAL = re.compile("[" + "".join(map(chr, CAPITALS)) + "]")


def is_western(text: str) -> bool:
    """Whether Latin-1 can hold the text, found out at the speed of a copy."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def has_newer(text: str) -> bool:
    return not is_western(text) and _NEWER_CHARACTER.search(text) is not None


def lowered(text: str) -> str:
    """Lower case letter by letter; the final form of sigma is not used."""
    if not is_western(text):
        text = text.replace("Σ", "σ")
        if _CAPITAL.search(text):
            text = text.translate(CAPITALS)
    return text.lower()


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else the next free one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, free = [], 0x100
    for byte in range(256):
        letters.append(chr(byte) if byte in plain else chr(free))
        free += byte not in plain
    return letters



@dataclass
class Vocabulary:
    """Ids, merges by rank, and special strings."""

    tokens: dict[str, int]
    ranks: dict[int, int]  # left << 20 | right -> rank of the merge
    made: list[int]  # rank -> id of both together
    special: dict[str, int]
    word_end: str
    strings: list[str] = field(default_factory=list)

    @property
    def special_pattern(self) -> re.Pattern | None:
        longest = sorted(self.special, key=len, reverse=True)
        return re.compile("|".join(map(re.escape, longest))) if longest else None


def read_vocabulary(text: str) -> Vocabulary:
    file = json.loads(text)
    model = file["model"]
    tokens = model["vocab"]
    ranks, made = {}, []
    for rank, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        ranks[tokens[left] << 20 | tokens[right]] = rank
        made.append(tokens[left + right])
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    strings = [""] * (1 + max([*tokens.values(), *special.values()]))
    for name, number in {**tokens, **special}.items():
        strings[number] = name
    return Vocabulary(tokens, ranks, made, special, model.get("end_of_word_suffix") or "", strings)


def file_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
