"""Text, name and identifier normalisers as Column expressions (JVM-side only).

Patterns keep to the ASCII subset that Java and RE2 read alike, so every expression has a
SQL twin.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Literal repairs of extracted text, applied in this order.
REPAIRS = [("/H11011", "~"), ("/H11002", "-"), ("fe- males", "females"), ("fe-males", "females"), ("partici- pants", "participants"), ("partici-pants", "participants")]


def literal_replace(text: Column, pairs) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def squeeze(text: Column) -> Column:
    """Strip white space at both ends, of any kind."""
    return F.regexp_replace(text, r"^[ \t\r\n\f\x0B]+|[ \t\r\n\f\x0B]+$", "")


def clean_text(text: Column) -> Column:
    """Repair known glyph errors, then join words broken by a hyphen and white space."""
    return F.regexp_replace(literal_replace(text, REPAIRS), r"(?U)(\w+)-\s+(\w+)", "$1$2")


def tidy_layout(text: Column) -> Column:
    """Delete runs of underscores and asterisks; map replacement and times signs to = and x."""
    return F.translate(F.regexp_replace(text, r"_+|\*+", ""), "�×", "=x")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[ \t\r\n\f\x0B]+"), lambda w: w != ""))


def clean_markdown(text: Column) -> Column:
    """Drop lines of one to three digits, cap blank runs, mend blanks around punctuation, strip lines."""
    t = F.regexp_replace(text, r"(?m)^[ \t]*[0-9]{1,3}[ \t]*$", "")
    t = F.regexp_replace(t, r"\n{4,}", "\n\n\n")
    t = F.regexp_replace(t, r"[ \t]+([.,;:!?])", "$1")
    t = F.regexp_replace(t, r"([.,;:!?])([A-Za-z])", "$1 $2")
    return F.array_join(F.transform(F.split(t, "\n"), lambda line: F.trim(line)), "\n")


def clean_doi(doi: Column) -> Column:
    return F.trim(literal_replace(doi, [(p, "") for p in ("https://", "http://", "dx.doi.org/", "doi.org/", "DOI ")]))


def study_id(name: Column, number: Column | None = None) -> Column:
    """Author and year of a file name, else its first word; ``_EXPn`` where a number is given."""
    found = F.concat(F.regexp_extract(name, r"^([A-Za-z]+).*?([0-9]{4})", 1), F.regexp_extract(name, r"^([A-Za-z]+).*?([0-9]{4})", 2))
    base = F.when(found != "", found).otherwise(F.element_at(F.split(name, " "), 1))
    return base if number is None else F.concat(base, F.when(number.isNotNull(), F.concat(F.lit("_EXP"), number.cast("string"))).otherwise(""))


def experiment_id(name: Column, number: Column, year: str = "Unknown") -> Column:
    """``Author`` + first four-digit part of ``A - B - C`` names (else ``year``) + ``_En``."""
    parts = F.split(name, " - ")
    years = F.filter(parts, lambda p: p.rlike("^[0-9]{4}$"))
    author = F.element_at(F.split(F.element_at(parts, 1), " "), 1)
    return F.concat(author, F.coalesce(F.get(years, F.lit(0)), F.lit(year)), F.lit("_E"), number.cast("string"))


def suggested_study_id(authors: Column, year: Column, title: Column, ordinal: Column) -> Column:
    """First author's family name, year and ``EXPn`` of the title; ``UnknownN`` without authors."""
    first = F.regexp_extract(F.coalesce(authors, F.lit("")), "([A-Za-z]+)", 1)
    number = F.regexp_extract(F.upper(F.coalesce(title, F.lit(""))), "EXP[A-Z]* ?([0-9]+)", 1)
    base = F.when(first == "", F.concat(F.lit("Unknown"), ordinal.cast("string"))).otherwise(F.concat(first, F.coalesce(year.cast("string"), F.lit(""))))
    return F.concat(base, F.when(number != "", F.concat(F.lit("EXP"), number)).otherwise(""))


def paper_id(name: Column) -> Column:
    """One known extension off, lower case, stripped, blanks and underscores to one underscore."""
    return F.regexp_replace(F.trim(F.lower(F.regexp_replace(name, r"\.(?:pdf|PDF|txt|TXT)$", ""))), r"[_ \t\r\n]+", "_")


def author_year(name: Column) -> Column:
    """Lower-case author and year as a struct; empty strings where not found."""
    pattern = r"([A-Za-z]+)[_ \t]*([0-9]{4})"
    return F.struct(F.lower(F.regexp_extract(name, pattern, 1)).alias("author"), F.regexp_extract(name, pattern, 2).alias("year"))


def same_paper(a: Column, b: Column) -> Column:
    x, y = author_year(a), author_year(b)
    return (paper_id(a) == paper_id(b)) | ((x["author"] != "") & (x["author"] == y["author"]) & (x["year"] == y["year"]))


# What counts as no value in a gold table.
NO_VALUE = ["?", "null", "none", "", "n/a"]


def annotated(value: Column) -> Column:
    return value.isNotNull() & ~F.lower(F.trim(value)).isin(NO_VALUE)


def gold_value(value: Column, synonyms: dict[str, str] | None = None) -> Column:
    """Lower-case trimmed value, null tokens to null, synonyms to their canonical form."""
    plain = F.when(annotated(value), F.lower(F.trim(value)))
    if not synonyms:
        return plain
    return F.coalesce(F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])[plain], plain)


def source_class(source_type: Column, method: Column) -> Column:
    """regex, task1 or task2, read from a row's source type and method."""
    both = F.lower(F.concat_ws(" ", source_type, method))
    task1 = both.contains("task1") | both.contains("missed")
    task2 = both.contains("task2") | both.contains("new_param") | both.contains("discover")
    return F.when(task1, "task1").when(task2, "task2").otherwise("regex")


#: Sections of an assembled context: name, most characters (None: all), least characters.
CONTEXT_PARTS = [("abstract", None, 50), ("introduction", 8000, 200), ("methods", None, 200), ("participants", 10000, 100), ("results", 6000, 200), ("discussion", 4000, 200)]


def assemble_context(sections: Column, text: Column, parts=CONTEXT_PARTS) -> Column:
    """Labelled sections, each cut and each only if long enough; else methods, else the text's first 5000 characters."""
    made = []
    for name, most, least in parts:
        body = F.element_at(sections, F.lit(name))
        cut = body if most is None else F.substring(body, 1, most)
        made.append(F.when(F.length(body) >= least, F.concat(F.lit(name.upper() + ":\n"), cut)))
    joined = F.concat_ws("\n\n", *made)
    return F.when(joined != "", joined).otherwise(F.coalesce(F.element_at(sections, F.lit("methods")), F.substring(text, 1, 5000)))


def build_prompt(template: str, context: Column, budget: int = 15000, **fields: Column) -> Column:
    """``${name}`` placeholders filled; the context is cut to what the budget leaves, 1000 at least."""
    room = max(1000, min(budget, 98304) - len(template))
    return reduce(lambda t, kv: F.replace(t, F.lit("${" + kv[0] + "}"), kv[1]), {**fields, "context": F.substring(context, 1, room)}.items(), F.lit(template))


def token_chunks(words: Column, size: int = 1000, overlap: int = 100) -> Column:
    """Arrays of ``size`` words that overlap; the last one ends with the text."""
    n, step = F.size(words), size - overlap
    last = F.greatest(F.ceil((n - overlap) / F.lit(step)).cast("int"), F.lit(1)) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(words, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<array<string>>"))


def chunk_blocks(blocks: Column, limit: int = 6000) -> Column:
    """Neighbouring (text, page) blocks joined while they have ``limit`` words at most; a longer block stands alone.

    Each chunk keeps the page of its first block.
    """
    chunk = "array<struct<text:string,page:int,words:int>>"
    begin = F.array().cast(chunk)

    def add(done: Column, b: Column) -> Column:
        n, last = word_count(b["text"]), F.element_at(done, -1)
        fits = (F.size(done) > 0) & (last["words"] + n <= limit)
        joined = F.struct(F.concat(last["text"], F.lit("\n"), b["text"]).alias("text"), last["page"].alias("page"), (last["words"] + n).alias("words"))
        new = F.struct(b["text"].alias("text"), b["page"].cast("int").alias("page"), n.alias("words"))
        kept = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(fits, F.concat(kept, F.array(joined))).otherwise(F.concat(done, F.array(new))).cast(chunk)

    return F.aggregate(blocks, begin, add)


def paragraphs(text: Column, least: int = 50) -> Column:
    """Stripped paragraphs longer than ``least`` characters with their page, ten to a page."""
    kept = F.filter(F.transform(F.split(text, "\n\n"), squeeze), lambda p: F.length(p) > least)
    return F.transform(kept, lambda p, i: F.struct(p.alias("text"), (F.floor(i / 10) + 1).cast("int").alias("page")))


def entry_status(confidence: Column) -> Column:
    return F.when(F.coalesce(confidence, F.lit(0.0)) < 0.7, "needs_review").otherwise("validated")


def complexity(text: Column) -> Column:
    """Layout traits of a page's text and their score."""
    lower = F.lower(text)
    tables = F.size(F.regexp_extract_all(lower, F.lit("table"), F.lit(0))) >= 2
    figures = F.size(F.regexp_extract_all(text, F.lit(r"Figure|Fig\."), F.lit(0))) >= 2
    scanned = F.length(text) < 500
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    short = F.size(F.filter(lines, lambda x: F.length(F.trim(x)) < 60))
    columns = (F.size(lines) > 0) & (short > 0.6 * F.size(lines))
    score = F.when(tables, 2).otherwise(0) + F.when(figures, 1).otherwise(0) + F.when(scanned, 3).otherwise(0) + F.when(columns, 2).otherwise(0)
    return F.struct(tables.alias("has_tables"), figures.alias("has_figures"), scanned.alias("is_scanned"), columns.alias("is_multi_column"), score.cast("int").alias("score"))


def route(traits: Column, heavy_available: bool = True, forced: str | None = None) -> Column:
    """The preprocessor for a document: the heavy one for tables, figures, scans or a score of five."""
    if forced:
        return F.lit(forced)
    heavy = traits["has_tables"] | traits["has_figures"] | traits["is_scanned"] | (traits["score"] >= 5)
    return F.when(heavy & F.lit(heavy_available), "layout_model").otherwise("layout_text")
