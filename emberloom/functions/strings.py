"""String expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    """Null, '' and white space all mean that nothing was observed."""
    return F.nullif(F.trim(c), F.lit(""))


def first_known(*columns: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in columns])


def provenance(**columns: Column) -> Column:
    """Name of the first column that has a value."""
    out = None
    for name, c in columns.items():
        found = blank_to_null(c).isNotNull()
        out = F.when(found, name) if out is None else out.when(found, name)
    return out


def tokens(c: Column) -> Column:
    """Lower-case runs of Latin letters, Hangul or digits; a run equal to the one before goes."""
    runs = F.regexp_extract_all(F.lower(c), F.lit("([a-z]+|[가-힣ㄱ-ㅎㅏ-ㅣ]+|[0-9]+)"), F.lit(1))
    before = F.concat(F.array(F.lit(None).cast("string")), runs)
    kept = F.zip_with(runs, before, lambda x, y: F.when(y.isNull() | (x != y), x))
    return F.coalesce(F.filter(kept, lambda x: x.isNotNull()), F.array())


def without(all_tokens: Column, generic: Column) -> Column:
    """Tokens that are not generic; all of them if nothing would be left."""
    left = F.filter(all_tokens, lambda t: ~F.array_contains(generic, t))
    return F.when(F.size(left) > 0, left).otherwise(all_tokens)


def jamo(c: Column) -> Column:
    """The string with each Hangul syllable written as initial, vowel and, if any, final."""
    letters = F.split(c, "")

    def parts(x: Column) -> Column:
        code = F.ascii(x) - 0xAC00
        final = code % 28
        return F.when(
            x.between("가", "힣"),
            F.concat(
                F.element_at(F.array(*[F.lit(k) for k in INITIALS]), (F.floor(code / 588) + 1).cast("int")),
                F.element_at(F.array(*[F.lit(k) for k in VOWELS]), (F.floor((code % 588) / 28) + 1).cast("int")),
                F.element_at(F.array(*[F.lit(k) for k in FINALS]), (final + 1).cast("int")),
            ),
        ).otherwise(x)

    return F.array_join(F.transform(letters, parts), "")


#: Jamo in syllable order; the first final is none.
INITIALS = list("ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ")
VOWELS = list("ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ")
FINALS = ["", *"ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"]


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 0 for two empty strings."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longer > 0, 1 - F.levenshtein(a, b) / longer).otherwise(F.lit(0.0))


def spelling_keys(own: Column) -> Column:
    """What a name is compared by: its tokens joined and, of three at most, each of two letters or more."""
    joined = F.array(F.array_join(own, ""))
    single = F.filter(own, lambda t: F.char_length(t) >= 2)
    keys = F.when(F.size(own) <= 3, F.concat(joined, single)).otherwise(joined)
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


def spelling_similarity(keys_a: Column, keys_b: Column) -> Column:
    """Best edit similarity over two key lists; 0 if one is empty."""
    pairs = F.flatten(F.transform(keys_a, lambda x: F.transform(keys_b, lambda y: edit_similarity(x, y))))
    return F.coalesce(F.array_max(pairs), F.lit(0.0))


def match_tier(text: Column, needle: Column) -> Column:
    """0 equal, 1 starts with, 2 contains, null otherwise; both sides folded."""
    t, n = squeeze(text), squeeze(needle)
    return F.when(n == "", None).when(t == n, 0).when(t.startswith(n), 1).when(t.contains(n), 2)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def letters_and_digits(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def owner_key(c: Column) -> Column:
    """An owner's name without legal forms, punctuation and blanks."""
    bare = F.regexp_replace(F.lower(c), r"주식회사|유한회사|\(주\)|㈜|\b(?:co|corp|inc|ltd|llc|limited|company|corporation)\b\.?", "")
    return F.regexp_replace(bare, r"[\s\p{P}\p{S}]", "")


def brand_in_title(title: Column, brand: Column) -> Column:
    """A Hangul brand as a substring without blanks, a Latin one between word ends."""
    hangul = brand.rlike("[가-힣]")
    bare = F.regexp_replace(F.lower(title), r"\s", "").contains(F.regexp_replace(F.lower(brand), r"\s", ""))
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    word = padded.contains(F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(brand), r"[^\p{L}\p{N}]+", " ")), F.lit(" ")))
    return F.when(hangul, bare).otherwise(word)


def has_final(c: Column) -> Column:
    """Whether the last letter is a syllable with a final consonant (particle choice)."""
    last = F.substring(c, -1, 1)
    return last.between("가", "힣") & ((F.ascii(last) - 0xAC00) % 28 != 0)


def number_forms(c: Column) -> Column:
    """A 13-digit number with and without hyphens after 2 and 6 digits."""
    digits = F.regexp_replace(c, r"\D", "")
    hyphened = F.regexp_replace(digits, r"^(\d{2})(\d{4})(\d{7})$", "$1-$2-$3")
    return F.array_distinct(F.array(digits, hyphened))


def is_application_number(c: Column) -> Column:
    digits = F.regexp_replace(c, "[^0-9]", "")
    return (F.char_length(digits) == 13) & ~F.substring(digits, 1, 2).isin("10", "20", "30")


def name_bucket(c: Column) -> Column:
    """Kind of a title: blank, figure, no letters, short, other; the first that holds."""
    t = F.coalesce(F.trim(c), F.lit(""))
    return (
        F.when(t == "", "blank").when(t.contains("도형"), "figure").when(~t.rlike(r"\p{L}"), "no_letters").when(F.char_length(t) <= 2, "short").otherwise("other")
    )


def parse_date(c: Column) -> Column:
    """YYYYMMDD, dotted or dashed dates; else null."""
    return F.coalesce(F.try_to_date(c, "yyyyMMdd"), F.try_to_date(c, "yyyy-MM-dd"), F.try_to_date(c, "yyyy.MM.dd"))
