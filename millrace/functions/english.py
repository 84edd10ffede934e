"""English text normalisation as Catalyst expressions: number words, contractions, tokens, stop words. Nulls stay null."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import EMAIL, HASHTAG, SPACES, URL, let

# Number words.
SMALL = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"
).split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = "thousand million billion trillion quadrillion quintillion sextillion septillion octillion nonillion decillion".split()

# Contractions that keep their apostrophe.
CONTRACTIONS = (
    "aren't can't couldn't didn't doesn't don't hadn't hasn't haven't he's i'm i've isn't it's she's shouldn't that's there's "
    "they're they've we're we've weren't what's where's who's won't wouldn't you're you've"
).split()

# English stop words.
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she "
    "she's her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll these "
    "those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over "
    "under again further then once here there when where why how all any both each few more most other some such no nor not only "
    "own same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't "
    "didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't "
    "shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()

# Words that are dropped besides, before term statistics and before LDA.
EXTRA_TERM_WORDS = ["didn", "amp", "quinta"]
EXTRA_LDA_WORDS = ["dog", "pet", "hotel", "room", "stay", "friendly", "clean", "staff", "la", "quinta"]

# Lemmas of irregular words.
IRREGULAR = {
    "is": "be", "are": "be", "was": "be", "were": "be", "am": "be", "been": "be", "has": "have", "had": "have", "does": "do", "did": "do",
    "went": "go", "gone": "go", "said": "say", "made": "make", "took": "take", "taken": "take", "came": "come", "saw": "see", "seen": "see",
    "got": "get", "gave": "give", "given": "give", "found": "find", "thought": "think", "told": "tell", "left": "leave", "felt": "feel",
    "brought": "bring", "bought": "buy", "paid": "pay", "kept": "keep", "ate": "eat", "slept": "sleep", "children": "child", "people": "people",
    "men": "man", "women": "woman", "feet": "foot", "teeth": "tooth", "mice": "mouse", "geese": "goose", "better": "well", "best": "well",
}
# Fixed rules: pattern of a word (its first group is the stem) and what follows the stem; the first that fits holds.
LEMMA_RULES = (
    ("^(.*[^aeiou])ies$", "y"), ("^(.+(?:ss|sh|ch|x|z))es$", ""), ("^(.+[^sui])s$", ""), ("^(.*[^aeiou])ied$", "y"),
    *((f"^(.*[aeiouy]{c}){c}(?:ed|ing)$", "") for c in "bdgmnprt"),
    ("^(.*[aeiouy].*[^e])ed$", ""), ("^(.*[aeiouy].*)ing$", ""),
)

#: Digits of the longest run that becomes words; longer runs stay as they are.
MOST_DIGITS = 3 * (1 + len(SCALES))
#: Private characters that stand for the apostrophes of contractions.
STRAIGHT, CURLY = "\ue000", "\ue001"


def _words(*items: str) -> Column:
    return F.array(*map(F.lit, items))


def _below_thousand(n: Column) -> Column:
    rest = n % 100
    low = F.when(rest < 20, F.get(_words(*SMALL), rest)).otherwise(
        F.concat(F.get(_words(*TENS), F.floor(rest / 10).cast("int") - 2), F.when(rest % 10 > 0, F.concat(F.lit("-"), F.get(_words(*SMALL), rest % 10))).otherwise(""))
    )
    hundreds = F.concat(F.get(_words(*SMALL), F.floor(n / 100).cast("int")), F.lit(" hundred"))
    return F.when(n < 100, low).when(rest == 0, hundreds).otherwise(F.concat(hundreds, F.lit(" and "), low))


def _spelled(run: Column) -> Column:
    """Words of a string of ASCII digits."""
    padded = F.lpad(run, MOST_DIGITS, "0")
    last = len(SCALES)
    groups = F.transform(F.array(*map(F.lit, range(last + 1))), lambda k: F.struct(k.alias("k"), F.substr(padded, 3 * k + 1, F.lit(3)).cast("int").alias("n")))
    named = F.transform(
        F.filter(groups, lambda g: g["n"] > 0),
        lambda g: F.concat(
            F.when((g["k"] == last) & (g["n"] < 100), " and ").otherwise(", "), _below_thousand(g["n"]),
            F.when(g["k"] < last, F.concat(F.lit(" "), F.get(_words(*SCALES), last - 1 - g["k"]))).otherwise(""),
        ),
    )
    joined = F.regexp_replace(F.array_join(named, ""), "^(, | and )", "")
    return F.when(F.length(run) > MOST_DIGITS, run).when(joined == "", SMALL[0]).otherwise(joined)


def number_words(text: Column) -> Column:
    """Every run of ASCII digits becomes its English number; runs of more than MOST_DIGITS digits stay."""
    between, runs = F.split(text, "[0-9]+"), F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))
    joined = let(F.transform(runs, _spelled), lambda spelled: F.array_join(F.transform(between, lambda x, i: F.concat(x, F.coalesce(F.get(spelled, i), F.lit("")))), ""))
    return F.when(text.rlike("[0-9]"), joined).otherwise(text)


def _held(text: Column) -> Column:
    """Apostrophes of contractions as private characters."""
    for mark, private in (("'", STRAIGHT), ("’", CURLY)):
        for tail in sorted({c.split("'")[1] for c in CONTRACTIONS}):
            heads = "|".join(sorted(c.split("'")[0] for c in CONTRACTIONS if c.split("'")[1] == tail))
            text = F.regexp_replace(text, rf"(?i)(?<![\p{{L}}\p{{N}}_])({heads}){mark}({tail})(?![\p{{L}}\p{{N}}_])", f"$1{private}$2")
    return text


def clean_characters(text: Column) -> Column:
    """Addresses, links and hashtags go; possessives split, contractions stay; other marks become spaces."""
    text = F.when(text.rlike("['’]"), _held(text)).otherwise(text)
    for pattern, new in (
        (EMAIL, ""), (URL, ""), (HASHTAG, ""), (r"([\p{L}\p{N}_])['’]s(?![\p{L}\p{N}_])", "$1 s"), ("[/-]", " "),
        (rf"[^\p{{L}}\p{{N}}_\s'{STRAIGHT}{CURLY}]", " "), (SPACES, " "),
    ):
        text = F.regexp_replace(text, pattern, new)
    return F.trim(F.translate(text, STRAIGHT + CURLY, "'’"))


def clean_review(text: Column) -> Column:
    """Number words, then ``clean_characters``."""
    return clean_characters(number_words(text))


def tokens(text: Column) -> Column:
    """Lower-case tokens: letters joined by ' - _ first, then runs of word characters, then single marks."""
    lower = F.lower(F.translate(text, "’", "'"))
    return F.regexp_extract_all(lower, F.lit(r"[\p{L}](?:[\p{L}'_-])+[\p{L}]|[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"), F.lit(0))


def content_words(text: Column, stop_words: list[str] = STOP_WORDS, keep_contractions: bool = True) -> Column:
    """Plain lower-case words of the tokens without stop words; contractions are exempt unless said otherwise."""
    plain = F.filter(tokens(text), lambda t: t.rlike("^[a-z]+(?:[-'][a-z]+)*$"))
    stop = [w for w in stop_words if not (keep_contractions and w in CONTRACTIONS)]
    return F.filter(plain, lambda t: ~t.isin(stop))


def without_stop_words(text: Column, keep_contractions: bool = True) -> Column:
    return F.array_join(content_words(text, keep_contractions=keep_contractions), " ")


def plain_keyword(keyword: str, stop_words: list[str] = STOP_WORDS, keep_contractions: bool = True) -> str:
    """``without_stop_words`` of a single string on the driver, for lexicons."""
    lower = keyword.replace("’", "'").lower()
    words = re.findall(r"[^\W\d_](?:[^\W\d_]|['_-])+[^\W\d_]|\w+|[^\s\w]", lower)
    kept = [w for w in words if re.fullmatch(r"[a-z]+(?:[-'][a-z]+)*", w)]
    return " ".join(w for w in kept if w not in stop_words or (keep_contractions and w in CONTRACTIONS))


def without_words(text: Column, stop_words: list[str]) -> Column:
    """The words between white space that aren't in the list, case kept; null gives an empty text."""
    words = F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(stop_words)), " ")


def lemma(word: Column) -> Column:
    """The base form: irregular words by table, else by the first rule that fits, else the word."""
    out = word
    for pattern, end in reversed(LEMMA_RULES):
        out = F.when(word.rlike(pattern), F.regexp_replace(word, pattern, "$1" + end)).otherwise(out)
    table = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    return F.coalesce(table[word], out)


def lemmas(text: Column) -> Column:
    """Every word's lemma, joined by spaces, spaced hyphens closed up; null gives an empty text."""
    words = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "), " ")
    return F.trim(F.replace(F.array_join(F.transform(words, lemma), " "), F.lit(" - "), F.lit("-")))


def letters_only(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Words for topic models: lower case, all but a-z and spaces deleted, stop words dropped; null gives no words."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z\s]", ""), r"\s+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(stop_words))


def iso_date(stamp: Column) -> Column:
    """The date of an ISO timestamp in its own offset; anything else as it is, null as empty."""
    good = stamp.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$") & F.try_to_timestamp(stamp).isNotNull()
    return F.when(stamp.isNull(), "").when(good, F.substring(stamp, 1, 10)).otherwise(stamp)


#: Frequent function words of each language.
LANGUAGE_WORDS = {
    "en": ["the", "and", "of", "to", "in", "that", "is", "was", "for", "with"],
    "de": ["der", "die", "und", "das", "ist", "nicht", "ein", "den", "mit", "von"],
    "fr": ["le", "la", "les", "et", "des", "est", "un", "une", "dans", "pour"],
    "es": ["el", "los", "las", "y", "que", "es", "una", "por", "con", "del"],
}


def language(text: Column) -> Column:
    """The language with most function words (ties in the order above); unknown for blank and null texts or without any."""
    def hits(words: Column, known: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(known)))

    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+")
    best = let(words, lambda ws: F.array_max(F.array(*[
        F.struct(hits(ws, known).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("lang")) for i, (k, known) in enumerate(LANGUAGE_WORDS.items())
    ])))
    return F.when(best["n"] > 0, best["lang"]).otherwise("unknown")
