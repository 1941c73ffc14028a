"""Text cleaning, tokens and word n-grams as column expressions."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterable, Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

from plaudit.rules import (
    CONTRACTION_STUMPS,
    CONTRACTIONS,
    LEMMA_MIN_CHARS,
    LEMMA_SUFFIXES,
    LEMMA_WORDS,
)

# Every character that separates words, ASCII and Unicode; the same class text
# is valid for Java and RE2.
SPACE_CLASS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# The same class for Java: three tests turn most letters away, where the class alone takes one for each of its parts.
_SPACE_FIRST = rf"[\t-\x20\x{{85}}\x{{a0}}\x{{1680}}-\x{{3000}}&&[{SPACE_CLASS}]]"
NON_SPACE = f"[^{SPACE_CLASS}]+"
MARKUP = f"http{NON_SPACE}|www{NON_SPACE}|<[^>]+>"
NOT_LETTER = r"[^a-zA-Z]+"


def is_ascii(text: Column) -> Column:
    """Whether all characters are ASCII; null for null."""
    return F.octet_length(text) == F.length(text)


def split_words(text: Column) -> Column:
    """Runs of other characters than white space."""
    return F.filter(F.split(text, f"{_SPACE_FIRST}+"), lambda word: word != "")


def is_blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return text.isNull() | ~F.regexp_like(text, F.lit(f"[^{SPACE_CLASS}]"))


def strip_text(text: Column) -> Column:
    """Trim every kind of white space, not only U+0020."""
    return F.regexp_replace(text, f"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$", "")


def normalise_text(text: Column) -> Column:
    """Lower case, links and tags to blanks, letters only, single blanks."""
    no_markup = F.regexp_replace(F.lower(text), MARKUP, " ")
    return F.trim(F.regexp_replace(no_markup, NOT_LETTER, " "))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _cut_contractions(normalised: Column) -> Column:
    # Plain substring tests keep the six replacements off the texts without any.
    cut, present = normalised, F.lit(False)
    for word, pair in CONTRACTIONS:
        cut = F.regexp_replace(cut, rf"\b{word}\b", pair)
        present = present | F.contains(normalised, F.lit(word))
    return F.split(F.when(present, cut).otherwise(normalised), " ")


def word_tokens(normalised: Column) -> Column:
    """Words of normalised text; six contracted forms become two words each."""
    return F.filter(bind(normalised, _cut_contractions), lambda word: word != "")


def english_stop_words() -> list[str]:
    """Spark's English list without apostrophe forms, plus contraction stumps."""
    extra = {"cannot", "could", "ought", "would"}
    listed = StopWordsRemover.loadDefaultStopWords("english")
    return [w for w in listed if "'" not in w and w not in extra] + list(CONTRACTION_STUMPS)


def drop_stop_words(tokens: Column, stop_words: Iterable[str]) -> Column:
    """Keep words of two letters and more that are not stop words."""
    stop = sorted(set(stop_words))
    if not stop:
        return F.filter(tokens, lambda word: F.length(word) > 1)
    return F.filter(tokens, lambda word: (F.length(word) > 1) & ~word.isin(stop))


def suffix_lemma(word: Column, suffixes=LEMMA_SUFFIXES, words=LEMMA_WORDS) -> Column:
    """Noun lemma by ending, but for some listed nouns; the first fitting ending decides."""
    rule = F.when(F.length(word) < LEMMA_MIN_CHARS, word)
    if words:
        forms, lemmas = zip(*words)
        listed = F.create_map(*[F.lit(x) for pair in words for x in pair])
        rule = rule.when(word.isin(list(forms)), F.element_at(listed, word))
    for ending, replacement in suffixes:
        stem = F.substring(word, F.lit(1), F.length(word) - len(ending))
        rule = rule.when(F.endswith(word, F.lit(ending)), F.concat(stem, F.lit(replacement)))
    return rule.otherwise(word)


def dictionary_lemma(pairs: Sequence[tuple[str, str]]) -> Callable[[Column], Column]:
    """A function from a word to the dictionary's lemma, null where it has none.

    Maps are searched from their first entry on, so the dictionary is a constant array of many
    small maps, one of which a word's hash picks. Of repeated forms the first counts.
    """
    known = dict(reversed([(form, lemma) for form, lemma in pairs]))
    buckets: list[dict[str, str]] = [{} for _ in range(max(1, len(known) // 4))]
    for form, lemma in known.items():
        buckets[zlib.crc32(form.encode()) % len(buckets)][form] = lemma
    table = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,string>>")

    def look(word: Column) -> Column:
        return F.try_element_at(F.get(table, F.pmod(F.crc32(word), F.lit(len(buckets))).cast("int")), word)

    return look


def clean_tokens(
    text: Column, stop_words: Iterable[str], suffixes=LEMMA_SUFFIXES, lemmas: Sequence[tuple[str, str]] = ()
) -> Column:
    """Cleaned, filtered and lemmatised words; an empty array for blank text.

    ``lemmas`` (form, lemma) goes before the endings.
    """
    kept = drop_stop_words(word_tokens(normalise_text(text)), stop_words)
    kept = F.coalesce(kept, F.array().cast("array<string>"))
    if not suffixes and not lemmas:
        return kept

    def by_ending(word: Column) -> Column:
        return suffix_lemma(word, suffixes) if suffixes else word

    if not lemmas:
        return F.transform(kept, by_ending)
    look = dictionary_lemma(lemmas)
    return F.transform(kept, lambda word: F.coalesce(look(word), by_ending(word)))


def clean_text(
    text: Column, stop_words: Iterable[str], suffixes=LEMMA_SUFFIXES, lemmas: Sequence[tuple[str, str]] = ()
) -> Column:
    return F.array_join(clean_tokens(text, stop_words, suffixes, lemmas), " ")


def vectorizer_tokens(text: Column, stop_words: Iterable[str] = ()) -> Column:
    """Words of two and more word characters of lower-cased raw text."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    words = F.coalesce(words, F.array().cast("array<string>"))
    return drop_stop_words(words, stop_words)


def word_ngrams(tokens: Column, max_n: int = 2) -> Column:
    """All 1..``max_n``-grams, joined by a blank."""
    grams = [tokens]
    for n in range(2, max_n + 1):
        # Every word with its n-1 followers, shift by shift.
        count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
        joined = F.slice(tokens, 1, count)
        for k in range(1, n):
            joined = F.zip_with(joined, F.slice(tokens, k + 1, count), lambda a, b: F.concat_ws(" ", a, b))
        grams.append(F.when(F.size(tokens) >= n, joined).otherwise(F.array().cast("array<string>")))
    return F.concat(*grams) if len(grams) > 1 else tokens


def snippet(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)


def latin1_only(text: Column) -> Column:
    """Drop characters that Latin-1 cannot show."""
    return F.regexp_replace(text, r"[^\x{00}-\x{ff}]", "")
