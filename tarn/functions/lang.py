"""Language of a text by its script, its commonest function words and letters."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Function words that tell the languages of the Latin script apart.
WORDS = {
    "en": ("the", "of", "and", "to", "in", "that", "is", "was", "for", "with", "as", "are"),
    "de": ("der", "die", "und", "das", "den", "von", "zu", "mit", "ist", "des", "auf", "nicht"),
    "fr": ("le", "les", "et", "des", "en", "une", "du", "qui", "pour", "dans", "que", "la"),
    "es": ("el", "los", "las", "que", "en", "y", "del", "por", "con", "una", "de", "la"),
    "it": ("il", "gli", "che", "di", "della", "per", "non", "sono", "nel", "alla", "è", "una"),
    "pt": ("o", "os", "não", "uma", "do", "da", "em", "para", "com", "são", "ao", "mais"),
    "nl": ("de", "het", "een", "van", "en", "niet", "zijn", "voor", "met", "dat", "op", "aan"),
    "sv": ("och", "att", "det", "som", "en", "på", "är", "av", "för", "inte", "den", "med"),
    "da": ("og", "det", "at", "en", "af", "er", "til", "på", "ikke", "med", "den", "som"),
    "pl": ("i", "w", "nie", "na", "się", "z", "do", "że", "jest", "o", "jak", "dla"),
    "cs": ("a", "se", "v", "na", "je", "že", "s", "z", "do", "pro", "jsou", "by"),
    "tr": ("ve", "bir", "bu", "için", "ile", "da", "de", "çok", "olarak", "ne", "gibi", "daha"),
    "fi": ("ja", "on", "ei", "että", "se", "oli", "hän", "mutta", "ovat", "kun", "tai", "myös"),
    "hu": ("a", "az", "és", "hogy", "nem", "is", "egy", "van", "volt", "meg", "csak", "mint"),
    "ro": ("și", "în", "de", "la", "nu", "cu", "este", "pe", "care", "din", "mai", "sunt"),
    "id": ("yang", "dan", "di", "itu", "dengan", "untuk", "tidak", "ini", "dari", "dalam", "akan", "pada"),
}
#: Letters that some of these languages have and the others lack, or mostly lack.
LETTERS = {"de": "äöüß", "fr": "èêçàâîôûœ", "es": "ñíóúá¿¡", "pt": "ãõ", "sv": "åäö", "da": "æøå", "pl": "łżźśćńęą", "cs": "řěůčšž", "tr": "ışğ", "hu": "őű", "ro": "șțăâî"}
#: Scripts of one language or of one chosen language, as Unicode classes.
SCRIPTS = {"ru": "\\p{IsCyrillic}", "el": "\\p{IsGreek}", "he": "\\p{IsHebrew}", "ar": "\\p{IsArabic}", "hi": "\\p{IsDevanagari}", "th": "\\p{IsThai}", "ko": "\\p{IsHangul}", "ja": "\\p{IsHiragana}\\p{IsKatakana}", "zh": "\\p{IsHan}", "hy": "\\p{IsArmenian}", "ka": "\\p{IsGeorgian}"}
#: Letters by which another language of a script is known.
WITHIN = {"ru": {"uk": "іїєґ", "sr": "ђћџљњ", "bg": "ъ"}, "ar": {"fa": "پچژگ", "ur": "ٹڈڑے"}}


def detected(c: Column, default: str = "en", sample: int | None = None) -> Column:
    """Code of the language with the most function words (share of all words) and letters; ties to the first, no evidence to the default.

    ``sample`` looks at that many characters only. All letters and scripts that count stand beyond ASCII, so they are sought in what is left without it.
    """
    t = _bound(F.lower(c if sample is None else F.substring(c, 1, sample)), lambda low: F.struct(F.split(low, r"[^\p{L}]+").alias("words"), F.regexp_replace(low, r"[\x00-\x7F]+", "").alias("rest"), F.length(low).alias("length")))
    t = _bound(t, lambda t: F.struct(F.greatest(F.size(t["words"]), F.lit(1)).alias("n"), F.filter(t["words"], _among({w for stop in WORDS.values() for w in stop})).alias("known"), t["rest"].alias("rest"), t["length"].alias("length"), F.greatest(t["length"], F.lit(1)).alias("size")))
    t = _bound(t, lambda t: F.struct(F.array(*[_score(lang, t) for lang in WORDS]).alias("scores"), t["rest"].alias("rest"), t["length"].alias("length"), t["size"].alias("size")))
    return _bound(t, lambda t: _code(t, default))


def _score(lang: str, t: Column) -> Column:
    letters = _count(t["rest"], LETTERS[lang]) / t["size"] * 5 if lang in LETTERS else F.lit(0.0)
    return F.size(F.filter(t["known"], _among(WORDS[lang]))) / t["n"] + letters


def _code(t: Column, default: str) -> Column:
    best = F.array_max(t["scores"])
    out = F.when(best > 0, F.element_at(F.array(*[F.lit(x) for x in WORDS]), F.array_position(t["scores"], best).cast("int"))).otherwise(default)
    # another script: a text has a fifth of its characters in it; kana tell Japanese from Chinese
    for lang, chars in reversed(list(SCRIPTS.items())):
        name = F.lit(lang)
        for other, marks in WITHIN.get(lang, {}).items():
            name = F.when(_count(t["rest"], marks) * 200 >= t["length"], other).otherwise(name)
        out = F.when(_count(t["rest"], chars) / t["size"] >= (0.05 if lang == "ja" else 0.2), name).otherwise(out)
    return out


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body of a value that is worked out once, however often the body names it. Chained, not nested: Spark does not evaluate a Python function over a lambda that uses the variable of another."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _count(c: Column, chars: str) -> Column:
    """Characters of a class."""
    return F.length(F.regexp_replace(c, f"[^{chars}]+", ""))


def _among(words: Iterable[str]) -> Callable[[Column], Column]:
    return lambda w: w.isin(*sorted(words))


def mapped(code: Column, names: dict[str, str]) -> Column:
    """Another name of a language code where there is one."""
    m = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[code], code)
