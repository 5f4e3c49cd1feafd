"""Scalar text functions as Column expressions; what the JVM lacks (NFKC) is an Arrow function used only off ASCII."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Characters that the gate's fold leaves out, and the variants that it unifies.
GATE_IGNORED = " \t\r\n，,。.!?！？、；;：:\"'“”‘’（）()[]【】<>《》·-_/"
GATE_VARIANTS = ("讚赞", "贊贊")
#: Credit lines, as patterns on folded text, and the outro phrase.
CREDIT_PATTERNS = ("字幕.{0,20}社群提供", "社群提供.{0,8}字幕", "請不吝.{0,24}打賞", "明鏡與點點")
OUTRO_PHRASES = ("歡迎訂閱按讚分享",)
#: Punctuation that scoring leaves out, and characters without topical weight.
SCORE_PUNCTUATION = " \t\n\r!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~。，、！？；：「」『』（）《》〈〉【】〔〕…—～·．‧・“”‘’〜°％"
SUMMARY_IGNORED = " \t\r\n、，,。.！!？?…；;：:「」『』（）()【】《》\"'`~-—…"
SENTENCE = r"[^。！？!?…\n]+[。！？!?…]*"
GLOSS = r"[（(][^（()）]*[a-zA-Z][^（()）]*[)）]"
FURIGANA = r"([一-鿿々]+)[(（]([ぁ-ゖァ-ヿー]+)[)）]"
TAI_READING = r"\(([A-Za-zÀ-ʯ̀-ͯ̍'’\- ·.,!?]+)\)"
SECTION_LINE = r"^\s*(\[[^\]]{0,60}\]|【[^】]{0,60}】)\s*$"
INLINE_TAG = r"\[[^\]]{0,60}\]|【[^】]{0,60}】"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def class_of(chars: str) -> str:
    """A Java character class of these characters."""
    return "[" + "".join("\\" + c if not c.isalnum() and c.isascii() and c not in " \t\r\n" else c for c in chars) + "]"


def fold(c: Column | str, char_map: Mapping[str, str] | None = None) -> Column:
    """Search fold: lower case, after an optional character map (script variants)."""
    c = _c(c)
    if char_map:
        c = F.translate(c, "".join(char_map), "".join(char_map.values()))
    return F.lower(c)


def gate_fold(c: Column | str) -> Column:
    """Lower-cased text without white space and punctuation, with praise characters unified."""
    return F.lower(F.translate(F.translate(_c(c), *GATE_VARIANTS), GATE_IGNORED, ""))


def is_credit(c: Column | str) -> Column:
    return gate_fold(F.coalesce(_c(c), F.lit(""))).rlike("|".join(f"(?:{p})" for p in CREDIT_PATTERNS))


def is_outro(c: Column | str) -> Column:
    folded, hit = gate_fold(F.coalesce(_c(c), F.lit(""))), F.lit(False)
    for phrase in OUTRO_PHRASES:
        hit |= folded.contains(gate_fold(F.lit(phrase)))
    return hit


def should_drop(text: Column | str, no_speech: Column | str, rms: Column | str, no_speech_at: float, rms_at: float) -> Column:
    """Whether a recognised text is an invention: a credit line, or silence by both measures, or an outro on either."""
    silent = F.coalesce(_c(no_speech) >= no_speech_at, F.lit(False))
    quiet = F.coalesce(_c(rms) <= rms_at, F.lit(False))
    return is_credit(text) | (silent & quiet) | (is_outro(text) & (silent | quiet))


def drops(text: str, no_speech: float | None, rms: float | None, no_speech_at: float, rms_at: float) -> bool:
    """``should_drop`` of one text, for use inside a stream's state."""
    fold = lambda t: t.translate(str.maketrans(*GATE_VARIANTS)).translate(dict.fromkeys(map(ord, GATE_IGNORED))).lower()
    folded = fold(text)
    silent = no_speech is not None and no_speech >= no_speech_at
    quiet = rms is not None and rms <= rms_at
    if any(re.search(p, folded) for p in CREDIT_PATTERNS) or (silent and quiet):
        return True
    return (silent or quiet) and any(fold(p) in folded for p in OUTRO_PHRASES)


@pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(c: Column | str) -> Column:
    return _nfkc(_c(c))


@pandas_udf(StringType())
def slug(s: pd.Series) -> pd.Series:
    """ASCII letters and digits of the NFKD form, joined by hyphens, 48 characters at most."""

    def one(text):
        plain = unicodedata.normalize("NFKD", text or "").encode("ascii", "ignore").decode().lower()
        return "-".join("".join(ch if ch.isalnum() else " " for ch in plain).split())[:48].strip("-")

    return s.map(one)


def squeeze(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(c), r"(?U)\s+", " "))


def score_normalize(c: Column | str, cjk: bool = False, ascii_only: bool = False) -> Column:
    """Scoring form: NFKC (not needed on ASCII), lower case unless CJK, no punctuation and hence no ASCII spaces."""
    c = _c(c) if ascii_only else nfkc(c)
    return F.regexp_replace(F.translate(c if cjk else F.lower(c), SCORE_PUNCTUATION, ""), r"(?U)\s+", "" if cjk else " ")


def score_tokens(c: Column | str) -> Column:
    """Words for a true token error rate: lower case, punctuation as space, squeezed."""
    marks = SCORE_PUNCTUATION.strip()
    return F.filter(F.split(F.lower(F.translate(_c(c), marks, " " * len(marks))), r"(?U)\s+"), lambda w: w != "")


#: The separators of Unicode's class Zs, which SQL engines trim beside the plain space.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def strip_gloss(c: Column | str, otherwise: Column | str | None = None) -> Column:
    """Without bracketed readings in Latin letters and spaces around; where nothing else is there, ``otherwise`` (the text
    itself unless given) without spaces around."""
    c = _c(c)
    trimmed = lambda x: F.trim(x, F.lit(SPACES))
    return F.coalesce(F.nullif(trimmed(F.regexp_replace(c, GLOSS, "")), F.lit("")), trimmed(c if otherwise is None else _c(otherwise)))


def strip_furigana(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), FURIGANA, "$1")


def replace_longest_first(c: Column | str, pairs: Sequence[tuple[str, str]]) -> Column:
    """Literal replacements, longest source first; a later one sees what an earlier one wrote."""
    c = _c(c)
    for old, new in sorted((p for p in pairs if p[0]), key=lambda p: -len(p[0])):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def training_normalize(c: Column | str, lang: Column | str, pairs: Sequence[tuple[str, str]] = (), lower_en: bool = False) -> Column:
    """One lyric line as training text: tags out, NFKC, the language's own rule, white space squeezed."""
    lang, base = _c(lang), nfkc(F.regexp_replace(_c(c), INLINE_TAG, " "))
    bare = F.regexp_replace(base, TAI_READING, "")
    nan = replace_longest_first(F.when(bare.rlike("[\\u4e00-\\u9fff]"), bare).otherwise(base), pairs)
    english = F.lower(base) if lower_en else base
    return squeeze(F.when(lang == "nan", nan).when(lang == "ja", strip_furigana(base)).when(lang == "en", english).otherwise(base))


def is_section_line(c: Column | str) -> Column:
    return _c(c).rlike(SECTION_LINE)


def sounding(c: Column | str) -> Column:
    """Whether a character is neither white space nor punctuation."""
    return ~_c(c).rlike(r"(?U)^[\p{P}\s]?$")


def sentences(c: Column | str) -> Column:
    """Sentences with their end marks, trimmed, without empty ones."""
    found = F.regexp_extract_all(F.coalesce(_c(c), F.lit("")), F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != "")


def first_line(c: Column | str, most: int = 80) -> Column:
    """First line that isn't blank, at most so many characters, or an empty string."""
    lines = F.filter(F.transform(F.split(F.coalesce(_c(c), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.substring(F.coalesce(F.get(lines, 0), F.lit("")), 1, most)


def sanitize_id(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(c), r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")


def safe_id(c: Column | str) -> Column:
    """Whether an id can't leave its folder."""
    c = _c(c)
    return (c != "") & ~c.contains("/") & ~c.contains("\\") & ~c.contains("..")


def snippet(body: Column | str, needle: str, radius: int = 12, fallback: int = 48) -> Column:
    """The raw needle in brackets between its neighbours; without a hit the start of the body."""
    body = F.coalesce(_c(body), F.lit(""))
    at, n = F.locate(needle, body), len(needle)
    begin = F.greatest(at - radius, F.lit(1))
    stop = F.least(at + n - 1 + radius, F.length(body))
    part = F.concat(
        F.when(begin > 1, "…").otherwise(""),
        F.substring(body, begin, at - begin),
        F.lit(f"[{needle}]"),
        F.substring(body, at + n, stop - at - n + 1),
        F.when(stop < F.length(body), "…").otherwise(""),
    )
    return F.when(at > 0, part).otherwise(F.substring(body, 1, fallback))


def clock(seconds: Column | str) -> Column:
    """mm:ss.d"""
    tenths = F.floor(_c(seconds) * 10)
    return F.format_string("%02d:%02d.%d", F.floor(tenths / 600), F.floor(tenths / 10) % 60, tenths % 10)


def distinct_lower(items: Column | str, most: int = 4) -> Column:
    """Distinct trimmed lower-case entries in order, so many at most."""
    cleaned = F.filter(F.transform(_c(items), lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != ""))
    return F.slice(F.array_distinct(cleaned), 1, most)


#: What the transcript join leaves out when it compares.
JOIN_IGNORED = frozenset(" \t\r\n，,。.!?！？、；;：:\"'“”‘’（）()[]【】")


def spoken(text: str) -> list[tuple[str, int]]:
    """(case-folded character, place after it) of what counts for the join."""
    return [(ch.casefold(), i) for i, ch in enumerate(text, 1) if ch not in JOIN_IGNORED]


def overlaps(before: list[str], after: list[str]) -> list[int]:
    """Lengths, longest first, at which a start of ``after`` is an end of ``before``: the borders of after + before."""
    joined, border = [*after, None, *before], [0]
    for x in joined[1:]:
        k = border[-1]
        while k and joined[k] != x:
            k = border[k - 1]
        border.append(k + (joined[k] == x))
    out = []
    while (k := border[out[-1] - 1] if out else border[-1] if before else 0):
        out.append(k)
    return out


def is_han(ch: str) -> bool:
    return "一" <= ch <= "鿿"


def novel_part(transcript: str, current: str, cap: int | None = None, tail_chars: int = 160) -> str:
    """What ``current`` adds to the transcript: its longest start that ends the transcript is cut, if that is at least two
    characters near Han text and six elsewhere. ``cap`` bounds the overlap that may be cut (0: none); without a cap, a
    text that the transcript's tail holds adds nothing."""
    said = " ".join(current.split())
    if not (said and transcript):
        return said
    known, fresh = [c for c, _ in spoken(transcript[-tail_chars:])], spoken(said)
    letters = [c for c, _ in fresh]
    if cap is None and letters and "".join(letters) in "".join(known):
        return ""
    shortest = 2 if any(map(is_han, known[-24:] + letters[:24])) else 6
    longest = len(letters) if cap is None else cap
    shared = next((n for n in overlaps(known, letters) if shortest <= n <= longest), None)
    return f" {said}" if shared is None else said[fresh[shared - 1][1] :].lstrip(" ，,。.!?！？")


def prompt(context: Column | str, base: Column | str, terms: Column | str) -> Column:
    """Recent context, the language's own prompt, then distinct terms: the last survives where a model cuts from the front."""
    parts = F.array(squeeze(F.coalesce(_c(context), F.lit(""))), F.coalesce(_c(base), F.lit("")), F.array_join(F.array_distinct(F.filter(F.transform(_c(terms), lambda t: F.trim(t)), lambda t: t != "")), "、"))
    return F.nullif(F.array_join(F.filter(parts, lambda p: p != ""), " "), F.lit(""))


#: Language codes and the translation model's names for them.
FLORES = {
    "zh": "zho_Hant", "zh-tw": "zho_Hant", "zh-hant": "zho_Hant", "zh-cn": "zho_Hans", "zh-hans": "zho_Hans", "yue": "yue_Hant", "en": "eng_Latn",
    "ja": "jpn_Jpan", "ko": "kor_Hang", "th": "tha_Thai", "vi": "vie_Latn", "id": "ind_Latn", "ms": "zsm_Latn", "tl": "tgl_Latn", "de": "deu_Latn",
    "fr": "fra_Latn", "es": "spa_Latn", "pt": "por_Latn", "it": "ita_Latn", "nl": "nld_Latn", "ru": "rus_Cyrl", "uk": "ukr_Cyrl", "pl": "pol_Latn",
    "tr": "tur_Latn", "ar": "arb_Arab", "hi": "hin_Deva", "fa": "pes_Arab",
}


def flores(code: Column | str) -> Column:
    """The translation model's name for a language code; its own names pass, what isn't known is null."""
    code = F.trim(_c(code))
    table = F.create_map(*(F.lit(x) for pair in FLORES.items() for x in pair))
    own = F.when(code.contains("_") & (F.length(code) >= 7), code)
    return F.coalesce(F.try_element_at(table, F.replace(F.lower(code), F.lit("_"), F.lit("-"))), own)


def changed_part(old: Column | str, new: Column | str) -> Column:
    """(from, to): what is left of two texts without their common start and end."""
    old, new = _c(old), _c(new)
    least = F.least(F.length(old), F.length(new))

    def common(a: Column, b: Column, most: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
        return F.greatest(F.lit(0), F.least(most, F.coalesce(F.get(at, 0) - 1, most)))

    head = common(old, new, least)
    tail = common(F.reverse(old), F.reverse(new), least - head)
    rest = lambda x: F.trim(F.substring(x, head + 1, F.length(x) - head - tail))
    return F.struct(rest(old).alias("from"), rest(new).alias("to"))


def joiner(lang: Column | str) -> Column:
    """What stands between joined lines: nothing where words aren't spaced."""
    return F.when(_c(lang).isin("zh-TW", "ja"), "").otherwise(" ")


def singer(stem: Column | str) -> Column:
    """Singer's name in a clip id of the form mir1k_name_number..., else null."""
    return F.nullif(F.regexp_extract(_c(stem), r"^mir1k_([A-Za-z]+)_\d", 1), F.lit(""))


@pandas_udf(StringType())
def ascii_escape(s: pd.Series) -> pd.Series:
    """Text in ASCII, other characters as backslash escapes."""
    return s.map(lambda t: None if t is None else t.encode("ascii", "backslashreplace").decode())


def separates(mode: Column | str, is_mix: Column | str) -> Column:
    """Whether a song's voice is taken out of the mix first: always, never, or where it is a mix."""
    return F.when(_c(mode) == "always", True).when(_c(mode) == "never", False).otherwise(_c(is_mix))


def language_matches(value: Column | str, target: str, names: Mapping[str, str]) -> Column:
    """Whether a language column means the target: its name, its code, or the code without its region."""
    code = target.lower()
    return F.coalesce(F.lower(F.trim(_c(value))).isin(names.get(target, code), code, code.split("-")[0]), F.lit(False))


def rolling_context(transcript: Column | str, chars: int) -> Column:
    """The last so many characters of a transcript; none of them for 0."""
    return F.right(_c(transcript), F.lit(chars)) if chars > 0 else F.lit("")


def iso_seconds(ts: Column | str) -> Column:
    """ISO 8601 with seconds and offset."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ssxxx")


def stamp(ts: Column | str) -> Column:
    """A time as part of a file name."""
    return F.date_format(_c(ts), "yyyyMMdd-HHmmss")


#: Entries of a romanisation table that are sent to every task; a larger one is an error.
MOST_ROMANISED = 1_000_000


def romanised(c: Column | str, table: Mapping[str, str]) -> Column:
    """Text with what a table knows written in other letters, in one pass from the left: at each place the longest entry that
    stands there counts, and what no entry fits stays."""
    if len(table) > MOST_ROMANISED:
        raise ValueError(f"a romanisation table of {len(table)} entries is more than a task should hold")
    known = {k: v for k, v in table.items() if k}
    # Lengths to try by first character: most characters start few entries.
    tries: dict[str, list[int]] = {}
    for k in known:
        tries.setdefault(k[0], []).append(len(k))
    tries = {ch: sorted(set(n), reverse=True) for ch, n in tries.items()}

    def one(text: str) -> str:
        out, i = [], 0
        while i < len(text):
            for n in tries.get(text[i], ()):
                hit = known.get(text[i : i + n])
                if hit is not None:
                    out.append(hit)
                    i += n
                    break
            else:
                out.append(text[i])
                i += 1
        return "".join(out)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one, na_action="ignore")

    return run(_c(c))


def romanised_words(c: Column | str, table: Mapping[str, str]) -> Column:
    """Words of the romanised text in lower case, of a to z and apostrophes alone; words without one are left out."""
    words = F.split(F.lower(romanised(c, table)), r"\s+")
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, "[^a-z']", "")), lambda w: w != "")
