"""Text expressions as columns: whitespace, words, stems, shingles, headers, previews. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terazi.functions.turkish import turkish_lower

#: display names of the sources (fixed values)
SOURCE_LABELS = {
    "yargitay": "Yargıtay",
    "emsal": "UYAP Emsal",
    "danistay": "Danıştay",
    "aym_bb": "Anayasa Mahkemesi (Bireysel Başvuru)",
    "aym_norm": "Anayasa Mahkemesi (Norm Denetimi)",
}
#: group titles shown behind a chunk's header (fixed values)
GROUP_TITLES = {"dava_ozeti": "Dava özeti", "gerekce": "Gerekçe"}
#: words left out of stems (fixed values)
STOP_WORDS = (
    "için veya olan olarak gibi ile ama daha hangi nedir midir mıdır mudur müdür yoksa bile kadar sonra önce şimdi bizim bize benim"
).split()


def literal_map(values: dict[str, str]) -> Column:
    """A constant map column; a key it lacks gives null through try_element_at."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def mapped(col: Column, values: dict[str, str]) -> Column:
    """The value of a constant dictionary; null for null and unknown keys."""
    return F.try_element_at(literal_map(values), col)


def collapse_whitespace(text: Column) -> Column:
    """Runs of white space become one blank, ends are trimmed. Null stays null."""
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def words(text: Column) -> Column:
    """Pieces between white space; an empty or blank text has none, a null text gives null."""
    return F.filter(F.split(text, "(?U)\\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words; null for a null text."""
    return F.when(text.isNotNull(), F.size(words(text)))


def removed_percent(before: Column, after: Column) -> Column:
    """Share of words taken away in per cent; null where nothing was there before."""
    return F.lit(100.0) * (F.lit(1.0) - F.try_divide(after, before))


def terms(text: Column) -> Column:
    """Letter-or-number words in Turkish lower case."""
    return F.regexp_extract_all(turkish_lower(text), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))


def stems(text: Column, length: int = 5, least: int = 3) -> Column:
    """Distinct first letters of the words of at least `least` Turkish letters, without stop words."""
    found = F.regexp_extract_all(turkish_lower(text), F.lit("[a-zçğıöşü]{%d,}" % least), F.lit(0))
    kept = F.filter(found, lambda w: ~w.isin(STOP_WORDS))
    return F.array_distinct(F.transform(kept, lambda w: F.substring(w, 1, length)))


def overlap_share(mine: Column, other: Column) -> Column:
    """Share of the first set's elements that the second has; null if the first is empty or null."""
    return F.try_divide(F.size(F.array_intersect(mine, other)), F.nullif(F.size(mine), F.lit(0)))


def shingles(text: Column, width: int = 5) -> Column:
    """Distinct runs of `width` words; a shorter text has none, and a null text gives null.

    The words are laid beside themselves, shifted by one to width - 1 places: the text is cut a few times per row, not per word.
    """
    t = terms(text)
    n = F.greatest(F.size(t) - (width - 1), F.lit(0))
    names = [f"w{i}" for i in range(width)]
    beside = F.arrays_zip(*[F.slice(t, i + 1, n).alias(c) for i, c in enumerate(names)])
    return F.array_distinct(F.transform(beside, lambda z: F.concat_ws(" ", *[z[c] for c in names])))


def _given(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def header(source: Column, court: Column, case: Column, decision: Column, date: Column, full: bool = True) -> Column:
    """Source label, court, case and decision numbers and date, joined by blanks; missing and empty parts are left out."""
    parts = [F.coalesce(mapped(source, SOURCE_LABELS), source), _given(court)]
    if full:
        parts += [F.concat(_given(case), F.lit(" E.")), F.concat(_given(decision), F.lit(" K.")), _given(date)]
    return F.concat_ws(" ", *parts)


def case_name(source: Column, court: Column, case: Column) -> Column:
    """Label, court and case number as shown in result lists."""
    return F.concat_ws(" ", F.coalesce(mapped(source, SOURCE_LABELS), source), _given(court), _given(case))


def model_input(head: Column, group: Column, text: Column, template: str = "title: {title} | text: {text}") -> Column:
    """What an encoder reads for a chunk: its title and text put into the model's template."""
    title = F.concat_ws(" — ", head, mapped(group, GROUP_TITLES))
    before, rest = template.split("{title}") if "{title}" in template else ("", template)
    between, after = rest.split("{text}")
    return F.concat(F.lit(before), title if "{title}" in template else F.lit(""), F.lit(between), F.coalesce(text, F.lit("")), F.lit(after))


#: what an encoder expects before a query (fixed value)
QUERY_PROMPT = "task: search result | query: "


def query_input(query: Column, prompt: str = QUERY_PROMPT) -> Column:
    """What an encoder reads for a query: the model's prompt and the query."""
    return F.concat(F.lit(prompt), F.coalesce(query, F.lit("")))


def result_label(score: Column, name: Column, index: Column, count: Column, mark: Column | None = None) -> Column:
    """A line of a result list: mark, score with three digits, name, and which part of how many was found."""
    part = F.concat(F.lit(" (parça "), (index + 1).cast("string"), F.lit("/"), count.cast("string"), F.lit(")"))
    return F.concat(mark if mark is not None else F.lit(""), F.lit("["), F.format_string("%.3f", score), F.lit("] "), F.coalesce(name, F.lit("")), F.coalesce(part, F.lit("")))


def preview(text: Column, head: int = 200, tail: int = 120) -> tuple[Column, Column]:
    """First and last characters of a text."""
    return F.left(text, F.lit(head)), F.right(text, F.lit(tail))


def shorten(text: Column, width: int = 250) -> Column:
    """White space collapsed and cut at a word's end to at most width characters, with [...] where something is left out."""
    flat = collapse_whitespace(text)
    room = width - len(" [...]")
    cut = F.regexp_extract(flat, "(?s)^(.{0,%d})(?= |$)" % room, 1)
    return F.when(F.length(flat) <= width, flat).otherwise(F.trim(F.concat(cut, F.lit(" [...]"))))


def batch_rows(tokens: Column, budget: int = 16384) -> Column:
    """How many texts of so many tokens fit a batch; at least one."""
    return F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(tokens, F.lit(1)))).cast("int")
