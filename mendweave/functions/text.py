"""Text functions as Column builders, and an English stemmer for the one step that needs Python."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: English words without content of their own.
STOP_WORDS = (
    "a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "been", "but", "by", "can",
    "could", "did", "do", "for", "from", "had", "has", "have", "he", "her", "his", "how", "i", "if", "in", "into",
    "is", "it", "its", "more", "no", "not", "of", "on", "one", "or", "our", "out", "she", "so", "some", "than",
    "that", "the", "their", "them", "then", "there", "they", "this", "to", "up", "was", "we", "were", "what",
    "when", "which", "who", "will", "with", "would", "you", "your",
)
WORD = r"[\p{L}\p{N}_]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text) -> Column:
    """Lower-cased words in order; an underscore separates them."""
    return F.regexp_extract_all(F.lower(F.replace(_c(text), F.lit("_"), F.lit(" "))), F.lit(f"({WORD})"), 1)


def content_words(text) -> Column:
    """``words`` without stop words, repeats included."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(words(text), lambda w: ~F.array_contains(stop, w))


def shingles(tokens: Column, k: int = 5) -> Column:
    """Distinct k-word shingles; fewer words make one."""

    def of(t: Column) -> Column:
        n = F.size(t)
        some = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(t, i, k), " "))
        return F.when(n == 0, F.array().cast("array<string>")).when(n <= k, F.array(F.array_join(t, " "))).otherwise(F.array_distinct(some))

    return F.get(F.transform(F.array(tokens), of), 0)  # so that the tokens are found once, not for each shingle


def title_parts(title) -> Column:
    """A title cut at underscores, bars, dashes and double colons between its parts."""
    return F.filter(F.transform(F.split(_c(title), r"\s*(?:_|\||｜|::)\s*|\s+\p{Pd}+\s+"), lambda p: F.trim(p)), lambda p: p != "")


def plain_title(title) -> Column:
    """The first part of a title; apostrophes go, other signs but ``_`` and ``-`` become spaces."""
    first = F.coalesce(F.get(title_parts(title), 0), F.lit(""))
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(first, F.lit("'"), F.lit("")), r"[^0-9A-Za-z _-]", " "), r"\s+", " "))


def squeeze(text) -> Column:
    return F.regexp_replace(_c(text), r"[ \n\t]+", " ")


def ascii_only(text) -> Column:
    return F.regexp_replace(_c(text), r"[^\x00-\x7F]+", " ")


def lenient_ts(ts) -> Column:
    """A timestamp from 14, 8 or 4 leading digits; null if none fits."""
    t = _c(ts)
    return F.coalesce(F.try_to_timestamp(F.left(t, F.lit(14)), F.lit("yyyyMMddHHmmss")), F.try_to_timestamp(F.left(t, F.lit(8)), F.lit("yyyyMMdd")), F.try_to_timestamp(F.left(t, F.lit(4)), F.lit("yyyy")))


def complement(whole, part) -> Column:
    """The words of ``whole`` that are left when ``part``'s are taken out of it in order."""
    start = F.struct(F.split(_c(part), " ").alias("rest"), F.array().cast("array<string>").alias("left"))
    done = F.aggregate(
        F.split(_c(whole), " "),
        start,
        lambda s, w: F.when((F.size(s["rest"]) > 0) & (F.get(s["rest"], 0) == w), F.struct(F.slice(s["rest"], 2, F.greatest(F.size(s["rest"]) - 1, F.lit(0))).alias("rest"), s["left"].alias("left"))).otherwise(
            F.struct(s["rest"].alias("rest"), F.concat(s["left"], F.array(w)).alias("left"))
        ),
    )
    return F.array_join(done["left"], " ")


def sheet_column(n) -> Column:
    """The letters of a sheet's column, counted from 0."""
    n = _c(n).cast("int")
    letter = lambda x: F.char(x + 65)
    return F.when(n < 26, letter(n)).when(n < 702, F.concat(letter((n / 26).cast("int") - 1), letter(n % 26))).otherwise(F.concat(letter(((n - 702) / 676).cast("int")), letter(((n - 702) / 26 % 26).cast("int")), letter(n % 26)))


# --- Porter's second English stemmer, from its published description ------------

_VOWELS = set("aeiouy")
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Words with a stem of their own.
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEEP = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
#: Suffixes and what replaces them.
_STEP2 = (
    ("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"), ("biliti", "ble"),
    ("lessli", "less"), ("tional", "tion"), ("alism", "al"), ("aliti", "al"), ("ation", "ate"), ("entli", "ent"),
    ("fulli", "ful"), ("iviti", "ive"), ("ousli", "ous"), ("abli", "able"), ("alli", "al"), ("anci", "ance"),
    ("ator", "ate"), ("enci", "ence"), ("izer", "ize"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("ative", ""), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        for i in range(start, len(w) - 1):
            if w[i] in _VOWELS and w[i + 1] not in _VOWELS:
                return i + 2
        return len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-3] not in _VOWELS and w[-2] in _VOWELS and w[-1] not in _VOWELS and w[-1] not in "wxY"


def stem(word: str) -> str:
    """The stem of a lower-cased English word."""
    w = word.lstrip("'")
    if len(w) <= 2:
        return w
    if w in _SPECIAL:
        return _SPECIAL[w]
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in _VOWELS) else c for i, c in enumerate(w))
    r1, r2 = _regions(w)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in _KEEP:
        return w
    # participles
    for s in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(s):
            if s.startswith("eed"):
                if len(w) - len(s) >= r1:
                    w = w[: -len(s)] + "ee"
            elif any(c in _VOWELS for c in w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(_DOUBLES):
                    w = w[:-1]
                elif _short_end(w) and r1 >= len(w):
                    w += "e"
            break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    for s, new in _STEP2:
        if w.endswith(s):
            if len(w) - len(s) >= r1 and not (s == "ogi" and not w.endswith("logi")) and not (s == "li" and w[-3:-2] not in set("cdeghkmnrt")):
                w = w[: -len(s)] + new
            break
    for s, new in _STEP3:
        if w.endswith(s):
            if len(w) - len(s) >= (r2 if s == "ative" else r1):
                w = w[: -len(s)] + new
            break
    for s in _STEP4:
        if w.endswith(s):
            if len(w) - len(s) >= r2 and not (s == "ion" and w[-4:-3] not in ("s", "t")):
                w = w[: -len(s)]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def _stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        known: dict[str, str] = {}
        yield batch.map(lambda ws, known=known: None if ws is None else [known[w] if w in known else known.setdefault(w, stem(w)) for w in ws])


def stems(tokens) -> Column:
    """Stems of an array of words; a worker remembers the words of a batch."""
    return F.pandas_udf(_stems, "array<string>")(_c(tokens))
