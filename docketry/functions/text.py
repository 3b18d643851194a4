"""Text functions as native column expressions: everything here stays inside the JVM.

Regular expressions use Java's Unicode classes, ``(?U)``, because texts are multilingual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lit_array(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def strip(text) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(_c(text), r"(?U)^\s+|\s+$", "")


def nullif_empty(text) -> Column:
    return F.nullif(_c(text), F.lit(""))


def fixed(x, places: int) -> Column:
    """A number of 0 or more with so many places, rounded by its exact binary value, to even on a tie.

    The product with the power of ten is split into its rounded value and the rest, so that 0.2825,
    which lies below its decimal, becomes 0.282.
    """
    ten = float(10**places)
    v = _c(x).cast("double")
    big = v * F.lit(134217729.0)
    high = big - (big - v)
    product = v * F.lit(ten)
    rest = (high * F.lit(ten) - product) + (v - high) * F.lit(ten)
    whole = F.floor(product)
    over = ((product - whole) - F.lit(0.5)) + rest
    digits = whole + F.when((over > 0) | ((over == 0) & (whole % 2 == 1)), 1).otherwise(0)
    return F.when(v.isNotNull(), F.format_string(f"%d.%0{places}d", F.floor(digits / F.lit(ten)).cast("bigint"), (digits % F.lit(int(ten))).cast("bigint")))


# --- normalisation ---------------------------------------------------------------------------


def map_punctuation(text) -> Column:
    return F.replace(F.translate(_c(text), rules.PUNCTUATION_FROM, rules.PUNCTUATION_TO), F.lit(rules.ELLIPSIS), F.lit("..."))


def strip_controls(text) -> Column:
    return F.regexp_replace(_c(text), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def normalize_whitespace(text) -> Column:
    t = F.regexp_replace(_c(text), r"\r\n?", "\n")
    # translate: the zero-width characters have no counterpart and vanish
    t = F.translate(t, rules.SPACES + rules.ZERO_WIDTH, " " * len(rules.SPACES))
    t = F.regexp_replace(t, r"[ \t\f\x0b]+", " ")
    t = F.regexp_replace(t, r"(?m)^ +| +$", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


# --- metadata --------------------------------------------------------------------------------


_LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def lines(text) -> Column:
    return F.split(_c(text), _LINE_BREAK, -1)


def first_line(text) -> Column:
    return F.get(F.filter(F.transform(lines(text), strip), lambda x: x != ""), F.lit(0))


def jurisdiction_label(code) -> Column:
    """Name of a jurisdiction; a code without one stands for itself."""
    out = _c(code)
    for key, label in rules.JURISDICTIONS.items():
        out = F.when(_c(code) == key, F.lit(label)).otherwise(out)
    return out


def resolve_title(title, text, jurisdiction) -> Column:
    own = nullif_empty(strip(F.coalesce(_c(title), F.lit(""))))
    return F.left(F.coalesce(own, first_line(text), F.concat(jurisdiction_label(jurisdiction), F.lit(" document"))), F.lit(512))


def reference_number(text) -> Column:
    found = [nullif_empty(F.regexp_extract(_c(text), f"(?iU){p}", g)) for p, g in rules.REFERENCES]
    return F.left(F.regexp_replace(strip(F.coalesce(*found)), r"[.,;]+$", ""), F.lit(256))


def _month(name: Column) -> Column:
    """Number of an English month by its name or first three letters; NULL for other words."""
    low = F.lower(name)
    out = F.when(F.lit(False), F.lit(0))
    for i, month in enumerate(rules.MONTHS, 1):
        short = [month, month[:3]] + (["sept"] if month == "september" else [])
        out = out.when(low.isin(*short), F.lit(i))
    return out


def published_date(text) -> Column:
    """First match of each form is tried in turn: ISO, D/M/Y, 31st January 2024, January 31, 2024."""
    t = _c(text)
    iso = r"(?U)\b(\d{4})-(\d{1,2})-(\d{1,2})\b"
    dmy = r"(?U)\b(\d{1,2})[/-](\d{1,2})[/-](\d{4})\b"
    day_first = r"(?iU)\b(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]+),?\s+(\d{4})\b"
    month_first = r"(?iU)\b([A-Za-z]+)\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})\b"

    def found(form, year, month, day):
        # the text is searched once for each form; the parts are those of the match alone
        match = F.array(F.regexp_extract(t, form, 0))
        return F.get(F.transform(match, lambda m: date(year(m, form), month(m, form), day(m, form))), F.lit(0))

    def part(g):
        return lambda m, form: F.regexp_extract(m, form, g)

    def named(g):
        return lambda m, form: _month(F.regexp_extract(m, form, g))

    def date(y, m, d):
        return F.try_to_date(F.concat_ws("-", y, F.lpad(m.cast("string"), 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")

    return F.coalesce(
        found(iso, part(1), part(2), part(3)),
        found(dmy, part(3), part(2), part(1)),
        found(day_first, part(3), named(2), part(1)),
        found(month_first, part(3), named(1), part(2)),
    )


# --- hashing ---------------------------------------------------------------------------------


def content_hash(text) -> Column:
    return F.sha2(strip(F.regexp_replace(F.lower(_c(text)), r"(?U)\s+", " ")), 256)


def tokens(text) -> Column:
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def word_count(text) -> Column:
    return F.size(F.filter(F.split(_c(text), r"(?U)\s+"), lambda x: x != ""))


def shingles(words, k: int = 3) -> Column:
    """Distinct k-word sequences; the distinct words where there are fewer than k."""
    w = _c(words)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))
    return F.when(F.size(w) >= k, F.array_distinct(runs)).otherwise(F.array_distinct(w))


def jaccard(a, b) -> Column:
    both = F.size(F.array_union(_c(a), _c(b)))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(_c(a), _c(b))) / both)


def hamming(a, b) -> Column:
    return F.bit_count(_c(a).bitwiseXOR(_c(b)))


def hex64(x) -> Column:
    return F.lower(F.lpad(F.hex(_c(x)), 16, "0"))


def md5_64(text) -> Column:
    """First eight bytes of the MD5 as a signed number."""
    return F.conv(F.substring(F.md5(_c(text)), 1, 16), 16, -10).cast("long")


# --- language --------------------------------------------------------------------------------


def stop_word_tokens(text) -> Column:
    return F.regexp_extract_all(F.lower(_c(text)), F.lit("[a-zà-öø-ÿ]+"), F.lit(0))


def language(text, words) -> Column:
    """STRUCT<language, confidence>: by script, else by the share of stop words.

    ``words`` is a column made by ``stop_word_tokens`` in an earlier projection, so that the
    seven counts do not each split the text again.
    """
    t, w = _c(text), _c(words)
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    ranges = [rf"\x{{{a}}}-\x{{{b}}}" for _, a, b in rules.SCRIPTS]
    counts = [F.regexp_count(t, F.lit(f"[{r}&&\\p{{L}}]")) for r in ranges]
    top = F.greatest(*counts)
    script = F.when(F.lit(False), F.lit(""))
    for (name, _, _), n in zip(rules.SCRIPTS, counts):
        script = script.when(n == top, F.lit(name))
    by_script = (letters > 0) & (top > 0) & (top >= 0.3 * letters)

    def among(stop):
        return F.size(F.filter(w, lambda x: x.isin(*stop)))

    def by_words(hits):
        best = F.array_max(hits)
        word = F.when(best == 0, F.lit("en"))
        for i, name in enumerate(rules.STOPWORDS):
            word = word.when(F.get(hits, F.lit(i)) == best, F.lit(name))
        share = F.when(F.size(w) == 0, F.lit(0.0)).otherwise(best / F.size(w))
        return F.struct(word.alias("language"), F.bround(F.least(4 * share, F.lit(1.0)), 3).alias("confidence"))

    # a lambda, so that the words are counted once
    word = F.get(F.transform(F.array(F.array(*(among(s) for s in rules.STOPWORDS.values()))), by_words), F.lit(0))
    none = ~t.rlike(f"[{''.join(ranges)}]")  # most texts have no character of these scripts, and one search tells
    return F.when(none, word).when(by_script, F.struct(script.alias("language"), F.lit(0.9).alias("confidence"))).otherwise(word)


# --- boilerplate -----------------------------------------------------------------------------

_BOILERPLATE = "(?iuUs)" + "|".join(f"(?:{p})" for p in rules.BOILERPLATE)


def strip_boilerplate(df: DataFrame, text: str, out: str = "stripped", removed: str = "removed") -> DataFrame:
    """Adds the text without boilerplate lines and without short lines that stand three times or more in it, and the number of lines removed."""
    cut = df.withColumn("__lines", F.split(text, "\n", -1)).withColumn("__sorted", F.array_sort("__lines"))
    third = F.filter("__sorted", lambda x, i: (F.length(x).between(1, 80)) & (F.get(F.col("__sorted"), i - 2) == x))
    # behind a generator, so that the repeated lines are found once and not again for every line
    cut = cut.select("*", F.explode(F.array(F.coalesce(F.array_distinct(third), F.array().cast("array<string>")))).alias("__often"))
    kept = F.filter("__lines", lambda x: ~F.array_contains("__often", x) & ~strip(x).rlike(_BOILERPLATE))
    cut = cut.select("*", F.explode(F.array(F.coalesce(kept, F.array().cast("array<string>")))).alias("__kept"))
    joined = F.regexp_replace(F.regexp_replace(F.array_join("__kept", "\n"), r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")
    n_removed = F.when(F.col(text).isNull(), 0).otherwise(F.size("__lines") - F.size("__kept"))
    return cut.withColumns({out: F.when(F.col(text).isNotNull(), joined), removed: n_removed}).drop("__lines", "__sorted", "__often", "__kept")


# --- summaries -------------------------------------------------------------------------------

_PREFIXES = ("Title:", "Reference:", "Jurisdiction:")


def prompt_text(title, reference, jurisdiction, text) -> Column:
    """Title, reference and jurisdiction, where there are any, an empty line and the text."""
    told = (("Title: ", _c(title)), ("Reference: ", _c(reference)), ("Jurisdiction: ", jurisdiction_label(jurisdiction)))
    return F.concat_ws("\n", *(F.concat(F.lit(name), nullif_empty(value)) for name, value in told), F.lit(""), _c(text))


def _prefixed(line: Column) -> Column:
    out = F.lit(False)
    for p in _PREFIXES:
        out = out | line.startswith(p)
    return out


def headline(prompt) -> Column:
    good = F.filter(F.transform(lines(prompt), strip), lambda x: (x != "") & (F.length(x) <= 200) & ~_prefixed(x))
    return F.coalesce(F.get(good, F.lit(0)), strip(F.left(_c(prompt), F.lit(100))))


def body_of(prompt) -> Column:
    """The prompt without its lines of title, reference and jurisdiction."""
    return F.array_join(F.filter(lines(prompt), lambda x: ~_prefixed(x)), "\n")


def sentences(body) -> Column:
    return F.filter(F.transform(F.split(_c(body), "[.!?]+"), strip), lambda x: x != "")


def extractive_summary(body, found) -> Column:
    """Of a prompt's body and the sentences found in it: the first three, else its first 200 characters."""
    first = F.concat(F.array_join(F.slice(_c(found), 1, 3), ". "), F.lit("."))
    return F.left(F.when(F.size(_c(found)) > 0, first).otherwise(F.left(_c(body), F.lit(200))), F.lit(4000))


def topic_tags(body) -> Column:
    words = F.split(F.lower(_c(body)), r"(?U)\s+")
    return F.slice(F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 4) & w.rlike(r"^\p{L}+$")))), 1, 5)


def summarize(df: DataFrame, title="title", reference="reference_number", jurisdiction="jurisdiction", text="clean_text") -> DataFrame:
    """Adds headline, summary_text, key_changes, topic_tags and prompt_tokens."""
    out = df.withColumn("__prompt", prompt_text(title, reference, jurisdiction, text)).withColumn("__body", body_of("__prompt")).withColumn("__found", sentences("__body"))
    return out.withColumns(
        {
            "headline": headline("__prompt"),
            "summary_text": extractive_summary("__body", "__found"),
            "key_changes": F.slice("__found", 1, 3),
            "topic_tags": topic_tags("__body"),
            "prompt_tokens": word_count("__prompt"),
        }
    ).drop("__prompt", "__body", "__found")
