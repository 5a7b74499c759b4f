"""The English (Porter 2) stemmer as one column expression: its steps find a word's longest listed suffix and replace it under a condition.

Words are lower case, without apostrophes.  Apply it to distinct words rather than to their occurrences.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stop words and the published word and suffix lists of the stemmer.
STOP_WORDS = tuple(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they
    them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does
    did doing a an the and but if or because as until while of at by for with about against between into through during before after
    above below to from up down in out on off over under again further then once here there when where why how all any both each few
    more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {
    w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
}
KEPT_AFTER_PLURALS = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
DERIVATIONS = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
ADJECTIVES = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
ENDINGS = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_VOWEL, _OTHER = "[aeiouy]", "[^aeiouy]"
#: A short syllable at the end: its vowel stands between others (the last not w, x or Y), or begins the word.
_SHORT = f"({_OTHER}{_VOWEL}[^aeiouywxY]|^{_VOWEL}{_OTHER})$"
#: A word that ends otherwise has no suffix of any step and stays as it is.
_ENDS = "([eilsy]|ed|ing|er|ator|ion|ism|ic|[ae]nt)$"


def _suffix(word: Column, suffixes: tuple[str, ...] | Mapping[str, str]) -> Column:
    """The longest of the suffixes that the word ends with, or nothing: the leftmost match is the longest."""
    return F.regexp_extract(word, f"({'|'.join(suffixes)})$", 1)


def _new(suffix: Column, table: Mapping[str, str]) -> Column:
    out = F.lit("")
    for old, new in table.items():
        if new:
            out = F.when(suffix == old, new).otherwise(out)
    return out


def _after(word: Column, since: Column) -> Column:
    """Where the region begins that follows the first vowel and consonant from ``since`` on; the word's length if there is none."""
    head = F.length(F.regexp_extract(F.substring(word, since + 1, F.length(word)), f"^(.*?{_VOWEL}{_OTHER})", 1))
    return F.when(head > 0, since + head).otherwise(F.length(word))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it; the expression stays linear in size."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _chain(value: Column, steps: list[Callable[[Column], Column]]) -> Column:
    return _let(value, lambda w: _chain(steps[0](w), steps[1:])) if steps else value


def _cut(w: Column, suffixes: tuple[str, ...] | Mapping[str, str], body: Callable[[Column, Column, Column], Column]) -> Column:
    """``body`` of the suffix, what stands before it and that one's length."""
    return _let(_suffix(w, suffixes), lambda s: body(s, F.substring(w, F.lit(1), F.length(w) - F.length(s)), F.length(w) - F.length(s)))


def _plurals(w: Column) -> Column:
    def of(s: Column, base: Column, n: Column) -> Column:
        lost = F.when(s == "sses", F.concat(base, F.lit("ss"))).when(s.isin("ied", "ies"), F.concat(base, F.when(n > 1, "i").otherwise("ie")))
        return lost.when((s == "s") & w.rlike(f"{_VOWEL}.+s$"), base).otherwise(w)

    return _cut(w, ("sses", "ied", "ies", "us", "ss", "s"), of)


def _past(w: Column, r1: Column) -> Column:
    def of(s: Column, base: Column, n: Column) -> Column:
        double = base.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
        short = base.rlike(_SHORT) & (n <= r1)
        mended = F.when(double, F.substring(base, F.lit(1), n - 1)).when(base.rlike("(at|bl|iz)$") | short, F.concat(base, F.lit("e"))).otherwise(base)
        return F.when(s.isin("eed", "eedly"), F.when(n >= r1, F.concat(base, F.lit("ee"))).otherwise(w)).when((s != "") & base.rlike(_VOWEL), mended).otherwise(w)

    return _cut(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"), of)


def _derived(w: Column, r1: Column) -> Column:
    def of(s: Column, base: Column, n: Column) -> Column:
        holds = F.when(s == "ogi", base.endswith("l")).when(s == "li", base.rlike("[cdeghkmnrt]$")).otherwise(s != "")
        return F.when((n >= r1) & holds, F.concat(base, _new(s, DERIVATIONS))).otherwise(w)

    return _cut(w, DERIVATIONS, of)


def _adjectives(w: Column, r1: Column, r2: Column) -> Column:
    return _cut(w, ADJECTIVES, lambda s, base, n: F.when((s != "") & (n >= r1) & ((s != "ative") | (n >= r2)), F.concat(base, _new(s, ADJECTIVES))).otherwise(w))


def _endings(w: Column, r2: Column) -> Column:
    return _cut(w, ENDINGS, lambda s, base, n: F.when((s != "") & (n >= r2) & ((s != "ion") | base.rlike("[st]$")), base).otherwise(w))


def _last(w: Column, r1: Column, r2: Column) -> Column:
    def of(s: Column, base: Column, n: Column) -> Column:
        goes = F.when(s == "e", (n >= r2) | ((n >= r1) & ~base.rlike(_SHORT))).when(s == "l", (n >= r2) & base.endswith("l"))
        return F.when(goes, base).otherwise(w)

    return _cut(w, ("e", "l"), of)


def stem(word: Column) -> Column:
    """The stem of a word; a null word has none."""

    def of(y: Column, r1: Column, r2: Column) -> Column:
        final_y = lambda w: F.regexp_replace(w, f"(?<=.{_OTHER})[yY]$", "i")
        rest = [lambda w: _past(w, r1), final_y, lambda w: _derived(w, r1), lambda w: _adjectives(w, r1, r2), lambda w: _endings(w, r2), lambda w: _last(w, r1, r2)]
        return F.lower(_let(_plurals(y), lambda w: F.when(w.isin(*KEPT_AFTER_PLURALS), w).otherwise(_chain(w, rest))))

    # y is a consonant, here Y, where it begins the word or follows a vowel
    marked = F.regexp_replace(F.regexp_replace(word, "^y", "Y"), f"({_VOWEL})y", "$1Y")
    prefix = F.length(F.regexp_extract(word, "^(gener|commun|arsen)", 1))
    regular = _let(marked, lambda y: _let(F.when(prefix > 0, prefix).otherwise(_after(y, F.lit(0))), lambda r1: _let(_after(y, r1), lambda r2: of(y, r1, r2))))
    special = F.lit(None).cast("string")
    for one, its in EXCEPTIONS.items():
        special = F.when(word == one, its).otherwise(special)
    return F.coalesce(special, F.when((F.length(word) <= 2) | ~word.rlike(_ENDS), word), regular)
