"""Column expressions for text: entity rules, normalisation, word splitting.

All of these are built-in Spark SQL expressions (JVM side, inside whole-stage
codegen); no Python runs per row.  Patterns use explicit ASCII classes only, so
the Java regex engine and RE2-style engines agree on them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Default entity rule table (type, pattern): capitalised words, numbers, e-mail
# addresses.  Stand-in for a statistical recogniser; any (type, pattern) list
# can be passed instead.
DEFAULT_ENTITY_RULES = (
    ("CAP", "[A-Z][a-z]{3,}"),
    ("NUM", "[0-9]{2,}"),
    ("MAIL", "[a-z0-9.]+@[a-z0-9.]+"),
)

# Accent folding applied after lower-casing (the uncased word-piece convention
# removes combining marks).  Accented letters and their base letters, in order:
ACCENTED = "àáâãäåèéêëìíîïòóôõöùúûüýÿçñ"
UNACCENTED = "aaaaaaeeeeiiiiooooouuuuyycn"

# Word splitting: a run of characters that are neither white space nor ASCII
# punctuation (!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~), or one punctuation character
# on its own.  Java spelling (\p{Punct} is far cheaper per character than the
# equivalent list of ranges) and the POSIX spelling of the same sets for SQL.
WORD_PATTERN = "[^ \\t\\n\\r\\p{Punct}]+|\\p{Punct}"
WORD_PATTERN_POSIX = "[^ \\t\\n\\r[:punct:]]+|[[:punct:]]"

# The Unicode rule.  White space that ends a chunk; control and format characters,
# which are left out; scripts written without spaces, whose characters are words;
# punctuation, which is a word of its own (Unicode's, and the ASCII signs that
# Unicode counts as symbols).
UNICODE_SPACE = r"[\t\n\r\p{Z}]+"
UNICODE_DROPPED = r"[\p{Cc}\p{Cf}\x{FFFD}]"
IDEOGRAPHS = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}"
PUNCTUATION = r"\p{P}$+<=>^`|~"

# Words longer than this many characters become the unknown piece.
MAX_CHARS_PER_WORD = 100
# -----------------------------------------------------------------------------


def mention_array(text: Column, rules=DEFAULT_ENTITY_RULES) -> Column:
    """array<struct<type, pos, token>> of all rule matches in ``text``.

    One ``regexp_extract_all`` per rule over the whole text; ``pos`` numbers the
    matches of one type inside one text.
    """
    def tagger(etype):
        return lambda tok, i: F.struct(F.lit(etype).alias("type"), i.alias("pos"), tok.alias("token"))

    parts = [F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), tagger(etype))
             for etype, pattern in rules]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def normalize_text(text: Column) -> Column:
    """Lower-case and fold accents (uncased tokenisation).  A text of ASCII alone has no accents: it is lower-cased only."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(F.lower(text), ACCENTED, UNACCENTED))


def words(text: Column) -> Column:
    """array<string> of the words of the normalised text (whole text)."""
    return F.regexp_extract_all(normalize_text(text), F.lit(WORD_PATTERN), F.lit(0))


def chunks(text: Column) -> Column:
    """array<string> of the runs between Unicode white space, before any other step of the Unicode rule."""
    return F.filter(F.split(text, UNICODE_SPACE), lambda c: c != "")


_PATTERNS: dict = {}


def unicode_words(chunk: str) -> list[str]:
    """Words of one chunk: lower case, without accents (canonical decomposition, marks dropped), ideographs and
    punctuation on their own."""
    import unicodedata

    import regex
    if not _PATTERNS:
        wide = regex.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), IDEOGRAPHS)
        _PATTERNS["drop"] = regex.compile(UNICODE_DROPPED.replace(r"\x{FFFD}", "\ufffd"))
        _PATTERNS["marks"] = regex.compile(r"\p{Mn}+")
        _PATTERNS["words"] = regex.compile(f"[{wide}]|[{PUNCTUATION}]|[^{wide}{PUNCTUATION}]+")
    if not chunk.isascii():
        chunk = _PATTERNS["marks"].sub("", unicodedata.normalize("NFD", _PATTERNS["drop"].sub("", chunk).lower()))
    else:
        chunk = _PATTERNS["drop"].sub("", chunk).lower()
    return _PATTERNS["words"].findall(chunk)
