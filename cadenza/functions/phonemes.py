"""Phoneme classes, affixes and letter-to-sound rules, and column functions over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class inventory (0 is the blank, then the phonemes in order, last the silence between words).
BLANK, SILENCE, CLASSES = 0, 41, 42
PHONEMES = "AA AE AH AO AW AX AY B CH D DH EH ER EY F G HH IH IY JH K L M N NG OW OY P R S SH T TH UH UW V W Y Z ZH".split()

# Endings and beginnings of words with the phonemes they add, in the order they are tried.
POSSESSIVES = {"'S": "Z", "'D": "D", "'LL": "L", "'VE": "V", "'RE": "R", "'T": "T", "'M": "M"}
SUFFIXES = {
    "TION": "SH AH N", "SION": "ZH AH N", "NESS": "N AH S", "MENT": "M AH N T", "ABLE": "AH B AH L", "IBLE": "AH B AH L", "LING": "L IH NG", "INGS": "IH NG Z",
    "ALLY": "AH L IY", "EOUS": "IY AH S", "IOUS": "IY AH S", "ICAL": "IH K AH L", "LESS": "L AH S", "FUL": "F AH L", "EST": "AH S T", "ING": "IH NG",
    "LY": "L IY", "ED": "D", "ER": "ER", "EN": "AH N", "ES": "IH Z",
}
PREFIXES = {"OVER": "OW V ER", "UNDER": "AH N D ER", "FORE": "F AO R", "MIS": "M IH S", "OUT": "AW T", "PRE": "P R IY", "UN": "AH N", "RE": "R IY"}

# Spelling rules; a pair of letters goes before a single one, GH is silent.
PAIRS = {
    "TH": "TH", "SH": "SH", "CH": "CH", "PH": "F", "WH": "W", "NG": "NG", "CK": "K", "GH": "", "EE": "IY", "EA": "IY", "IE": "IY", "OO": "UW", "AI": "EY", "AY": "EY",
    "EI": "EY", "EY": "EY", "OI": "OY", "OY": "OY", "OU": "AW", "OW": "OW", "AU": "AO", "AW": "AO",
}
LETTERS = {
    "A": "AE", "B": "B", "C": "K", "D": "D", "E": "EH", "F": "F", "G": "G", "H": "HH", "I": "IH", "J": "JH", "K": "K", "L": "L", "M": "M", "N": "N", "O": "AA", "P": "P",
    "Q": "K", "R": "R", "S": "S", "T": "T", "U": "AH", "V": "V", "W": "W", "X": "K S", "Y": "IY", "Z": "Z",
}

# Words with the pronunciations that worked examples expect; a real dictionary is a table of the same shape.
SEED_DICTIONARY = {
    "father": "F AA DH ER", "the": "DH AH", "cat": "K AE T", "hello": "HH AH L OW", "world": "W ER L D", "aalborg": "AO L B AO R G", "kettle": "K EH T AH L", "sea": "S IY",
    "captain": "K AE P T AH N", "glide": "G L AY D", "tidy": "T AY D IY", "ship": "SH IH P", "masters": "M AE S T ER Z", "in": "IH N", "on": "AA N", "and": "AH N D", "for": "F AO R", "with": "W IH DH",
}

_CLASS = {p: i for i, p in enumerate(PHONEMES, 1)}


def classes(symbols: str) -> list[int]:
    """Classes of phonemes written with blanks between them; unknown ones are left out."""
    return [_CLASS[s] for s in symbols.split() if s in _CLASS]


def _literal(pairs: dict[str, str]) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.array(*map(F.lit, classes(v))).cast("array<int>"))])


def phoneme_class(symbol: Column) -> Column:
    """Class of a phoneme, one stress digit allowed; null if unknown. Case counts."""
    table = F.create_map(*[F.lit(x) for k, v in _CLASS.items() for x in (k, v)])
    return F.try_element_at(table, F.regexp_replace(symbol, "[012]$", ""))


def clean_token(token: Column) -> Column:
    """ASCII letters, apostrophes and hyphens, in upper case."""
    return F.upper(F.regexp_replace(token, "[^A-Za-z'-]", ""))


def parts(text: Column) -> Column:
    """What stands between white space (Unicode)."""
    return F.split(text, r"[\p{IsWhite_Space}]+")


def spoken(token: Column) -> Column:
    """Whether a token holds a letter or digit."""
    return token.rlike(r"[\p{IsAlphabetic}\p{N}]")


def tokens(text: Column) -> Column:
    """White-space separated tokens (Unicode) that hold a letter or digit."""
    return F.filter(parts(text), spoken)


def word_total(text: Column) -> Column:
    """Number of white-space separated tokens (Unicode)."""
    return F.size(F.filter(F.split(text, r"[\p{IsWhite_Space}]+"), lambda w: w != ""))


def letter_to_sound(word: Column) -> Column:
    """Classes by the spelling rules; non-letters are skipped."""
    units = F.regexp_extract_all(F.regexp_replace(F.upper(word), "[^A-Z]", ""), F.lit("|".join(PAIRS) + "|[A-Z]"), F.lit(0))
    return F.flatten(F.transform(units, lambda u: F.element_at(_literal(PAIRS | LETTERS), u)))
